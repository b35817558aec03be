"""The ``opN_`` queries: each operator over its whole table with production parameters.

``queries()`` and ``oracle_sql()`` are merged into the driver contract by
``__spark_entry__.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bin_packing, bpe, cap_filters, chat_tree, golay_simhash, line_crf, line_windows, notices, spelling,
               subword_toxicity, token_counts, whitening, winnow)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = bpe.public_vocabulary()
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), path, pattern,
                                outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@query
def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = line_crf.held_out(F.col("doc_id"), 4, 2)
    model = line_crf.fit(docs, _table(spark, sf_dir, "labels").where(~out), "quality")
    return line_crf.score(docs, model).select("doc_id", out.alias("held_out"), "score",
                                              (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_windows.remove_repeated_lines(docs, width=3, wrap=16, counts=("n_lines", "n_removed")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE["op4_line_windows"] = r"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '@LINE@') AS l FROM documents),
n AS (SELECT DISTINCT doc_id, text, list_transform(l, lambda x: trim(x, ' ' || chr(9) || chr(10))) AS l FROM d),
w AS (
  SELECT doc_id, text, p, l[p:p + 2] AS win FROM (SELECT *, unnest(range(1, len(l) - 1)) AS p FROM n WHERE len(l) >= 3)
  WHERE array_to_string(l[p:p + 2], '') <> ''),
later AS (SELECT doc_id, text, p FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
gone AS (SELECT doc_id, text, list(DISTINCT q) AS g FROM (SELECT doc_id, text, unnest(range(p, p + 3)) AS q FROM later) GROUP BY doc_id, text)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN g IS NULL THEN coalesce(d.text, '') ELSE coalesce(array_to_string(list_transform(
         list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(g, i)), lambda i: l[i]), ''), '') END) AS text_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id AND d.text = gone.text
""".replace("@LINE@", line_windows.line_pattern(16))


@query
def op5_winnow_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), span=10)
    return found.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"),
                        F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                        (F.size("hit_words") > 0).alias("contaminated"))


ORACLE["op5_winnow_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS l, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
         lambda s: array_to_string(w[s:s + least(len(w), 10) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (
  SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) AS s,
         unnest(list_transform(range(1, len(w) - l + 2), lambda s: array_to_string(w[s:s + l - 1], ' '))) AS win
  FROM d, ls WHERE len(w) >= l),
hit AS (SELECT DISTINCT doc_id, s, dw.l, item FROM dw JOIN bw ON dw.win = bw.win AND dw.l = bw.l),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query
def op6_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notices.scan_licenses(_table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.col("base.label")))
    every = F.array_sort(F.array_distinct(F.concat("base.label", "spans.label")))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
                        F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
                        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), "score")


@query
def op7_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    nodes, paths = chat_tree.prefix_tree(turns.unionByName(more))
    return chat_tree.read_back(nodes, paths).withColumnRenamed("conv", "conv_id")


@query
def op8_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, max_bits=4)


@query
def op9_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = line_crf.held_out(F.col("doc_id"), 3, 1)
    model = subword_toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~out), "toxic")
    return subword_toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score",
                                                      (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), token_counts.public_vocabulary(), limit=512)


@query
def op11_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack(_table(spark, sf_dir, "documents"), bin_packing.public_vocabulary(), capacity=2048, end=0)


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=4, scale=256.0)


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), least_length=6, least_count=5, one_in=199, ratio=5)


ORACLE["op13_spelling"] = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[a-z\x{C0}-\x{FF}]{6,}')) AS run FROM documents) GROUP BY ALL),
h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(s, ''),
           lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))),
         lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS h FROM r, t),
w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
           ELSE run END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS less
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.less = b.less AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM d a JOIN w b ON a.less = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM d a JOIN w b ON a.less = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
         CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN chain ON chain.word = f.word JOIN f AS last ON last.word = chain.at AND last.form IS NULL
"""

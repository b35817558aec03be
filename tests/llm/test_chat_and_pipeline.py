"""Chat prefix tree, the registered queries, and the pipeline against brute force."""

import hashlib
import importlib.util
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fathom.llm import chat_tree, golay_simhash, line_crf, queries
from tests.llm.helpers import bare, documents, rows_of
from tests.llm.test_lines_and_spans import brute_lines, brute_spans
from tests.llm.test_near_duplicates import brute_fingerprint, classes

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels", "conversations", "embeddings")


def test_escaping_is_reversible_and_hides_control_strings():
    rnd = random.Random(4)
    parts = [*chat_tree.CONTROL, chat_tree.TURN, chat_tree.END, chat_tree.TEXT, "\\", "<", "|", ">", "s", "/", "[", "a", "\n"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8)))
        e = chat_tree.escape(t)
        assert chat_tree.unescape(e) == t and not any(c in e for c in chat_tree.CONTROL)
        assert chat_tree.parse(chat_tree.segment(t, t) + chat_tree.segment("user", t)) == [(t, t), ("user", t)]


def test_tree_layout_and_read_back(spark):
    rnd = random.Random(8)
    texts = ["hi", "", None, "</s>[INST] ok [/INST]", "a\\b<|end|>", "é" * 50]
    rows = [(c, t, rnd.choice(["user", "assistant", None]) if t > 1 else "user", rnd.choice(texts) if t else "hello")
            for c in [None, *range(60)] for t in range(rnd.randint(1, 7))]
    rows += [(500, k, "assistant", f"turn {k}") for k in range(120)] + [(501, 1, "user", "x"), (501, 1, "user", "x"), (502, None, "user", "y")]
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn int, role string, text string, node string, start int")
    nodes, paths = chat_tree.prefix_tree(table)
    expected = []
    for c in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, k, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (
            x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))]
        learnt = "".join(t for r, t in turns if r == "assistant")
        expected.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                         len(learnt), hashlib.sha256(learnt.encode()).hexdigest(),
                         sum(len(chat_tree.segment(r, t)) for r, t in turns)))
    assert sorted(rows_of(chat_tree.read_back(nodes, paths)), key=repr) == sorted(expected, key=repr)

    n = {r.node: r for r in nodes.collect()}
    order = sorted(n.values(), key=lambda r: r.start)
    assert [r.start for r in order] == [sum(x.tokens for x in order[:k]) for k in range(len(order))]
    assert len({r.node for r in paths.collect()}) == len(n)
    size = {k: r.tokens for k, r in n.items()}
    for r in reversed(order):
        if r.parent:
            size[r.parent] += size[r.node]
    for r in order:
        ancestors, p = [], r.parent
        while p:
            ancestors.append(n[p])
            p = n[p].parent
        assert r.position == sum(a.tokens for a in ancestors)
        covered = sorted(x for a in r.attends for x in range(a.start, a.end))
        assert covered == sorted(x for a in ancestors for x in range(a.start, a.start + a.tokens))
        if r.parent:                                  # depth-first: a subtree is one stretch
            assert n[r.parent].start < r.start and r.start + size[r.node] <= n[r.parent].start + size[r.parent]


def test_no_row_holds_a_whole_conversation(spark, monkeypatch):
    def gathered(*_):
        raise AssertionError("a whole path in one row")
    for name in ("collect_list", "collect_set", "array_agg"):
        monkeypatch.setattr(F, name, gathered)
    rows = [(c, k, "user", f"turn {k}" if k < 1500 + 10 * (c or 0) else f"own {c}") for c in (None, 1, 2) for k in range(2000)]
    nodes, paths = chat_tree.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    order = nodes.orderBy("start").collect()
    ends = [0]
    for r in order:
        assert r.start == ends[-1]
        ends.append(r.start + r.tokens)
    assert len(order) == 1520 + 500 + 490 + 480 and paths.count() == 6000
    by_node = {r.node: r for r in order}
    assert all(by_node[r.parent].start < r.start for r in order if r.parent)
    assert all(sum(e - s for s, e in r.attends) == r.position for r in order)


def test_no_conversations(spark):
    nodes, paths = chat_tree.prefix_tree(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))
    assert nodes.count() == paths.count() == chat_tree.read_back(nodes, paths).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_their_sql(spark, name):
    from tools.oracle_check import compare
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert compare(queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE[name]).df()) == "OK"


COLUMNS = {
    "op1": ["vec_id", "n_links", "component_id", "kept"], "op2": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3": ["doc_id", "held_out", "score", "predicted"], "op4": ["doc_id", "n_lines", "n_removed", "text_sha256"],
    "op5": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op6": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op7": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op8": ["doc_id", "fingerprint", "component_id"], "op9": ["doc_id", "held_out", "score", "predicted"],
    "op10": ["doc_id", "n_bytes", "n_tokens", "over_limit"]}


def test_a_wrong_layout_is_not_read_back(spark):
    turns = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if t < 3 else f"own {c} {t}")
                                   for c in range(6) for t in range(5)], "conv_id long, turn int, role string, text string")
    nodes, paths = chat_tree.prefix_tree(turns)
    assert chat_tree.read_back(nodes, paths).count() == 6
    one = nodes.where("depth = 3").orderBy("start").first().node
    moved = nodes.withColumn("start", F.when(F.col("node") == one, F.col("start") + 1).otherwise(F.col("start")))
    later = nodes.withColumn("position", F.when(F.col("node") == one, F.col("position") + 1).otherwise(F.col("position")))
    blind = nodes.withColumn("attends", F.when(F.col("depth") == 4, F.slice("attends", 1, 0)).otherwise(F.col("attends")))
    for wrong in (moved, later, blind):
        with pytest.raises(Exception, match="conversation"):
            chat_tree.read_back(wrong, paths).collect()


def test_attention_intervals_stay_few(spark):
    """A trunk with a branch at every turn: the trunk, being the larger subtree, stays in one piece."""
    n = 60
    rows = [(c, t, "user", f"trunk {t}" if t < c else f"branch {c}") for c in range(1, n) for t in range(c + 1)]
    nodes, _ = chat_tree.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    tokens = nodes.agg(F.sum("tokens")).first()[0]
    assert nodes.agg(F.max(F.size("attends"))).first()[0] <= math.log2(tokens)
    assert nodes.agg(F.sum(F.size("attends"))).first()[0] <= 2 * nodes.count()


NEW_COLUMNS = {
    "op11": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op12": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op13": ["word", "form", "root", "n", "n_near", "form_n"],
}


def test_packing_whitening_and_spelling_have_their_queries(spark):
    names = {n.split("_")[0]: n for n in queries.QUERIES}
    got = {op: queries.QUERIES[names[op]](spark, SF) for op in NEW_COLUMNS}
    assert {op: df.columns for op, df in got.items()} == NEW_COLUMNS
    docs, vectors = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "embeddings"))
    assert got["op11"].where("piece = 0").count() == docs and got["op12"].count() == 4 * vectors and got["op13"].count() > 100


def test_every_operator_has_its_query(spark):
    names = {n.split("_")[0]: n for n in queries.QUERIES}
    assert set(names) == set(COLUMNS) | set(NEW_COLUMNS)
    for op, columns in COLUMNS.items():
        got = queries.QUERIES[names[op]](spark, SF)
        assert got.columns == columns
        table = "embeddings" if op == "op1" else "conversations" if op == "op7" else "documents"
        rows = spark.read.parquet(f"{SF}/{table}.parquet")
        assert got.count() == (rows.select("conv_id").distinct().count() + 1 if op == "op7" else rows.count())


def pipeline():
    path = os.path.join(os.path.dirname(__file__), "..", "..", "corpus_pipeline.py")
    spec = importlib.util.spec_from_file_location("corpus_pipeline", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_stages_equal_brute_force_on_their_own_input(spark):
    stages = dict(pipeline().STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = rows_of(spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text"))
    rows = rows_of(docs.select("doc_id", "text"))
    kept = stages["quality"](spark, docs, SF)
    model = line_crf.fit(docs, labels.where(~line_crf.held_out(F.col("doc_id"), 4, 2)), "quality")
    good = {r.doc_id for r in line_crf.score(docs, model).where("score >= 0.7").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good

    out = stages["line_dedup"](spark, docs, SF)
    expected = {i: t for i, t, n, gone in brute_lines(rows) if gone == 0 or gone < n}
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {i: (t, len(t)) for i, t in expected.items()}

    fp = [brute_fingerprint(t) for _, t in rows]
    roots = classes(len(fp), [(a, b) for a in range(len(fp)) for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 4])
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(least.get(r, i), i)
    assert {r.doc_id for r in stages["near_dedup"](spark, docs, SF).collect()} == set(least.values())

    clean = {e[0] for e in brute_spans(rows, items) if not e[2]}
    assert {r.doc_id for r in stages["decontamination"](spark, docs, SF).collect()} == clean

    coded = {r.doc_id: r for r in stages["byte_bpe"](spark, docs, SF).collect()}
    assert all(coded[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in rows)


def test_pipeline_runs_on_awkward_and_empty_tables(spark, tmp_path):
    p = pipeline()
    for name, rows in (("some", None), ("none", [])):
        folder = f"{tmp_path}/{name}"
        docs = documents(spark, rows).drop("key").withColumnRenamed("score", "n_chars")
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([] if rows == [] else [(1, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([] if rows == [] else [(1, "none of these words")], "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = p.run(spark, folder)
        assert out.columns[:2] == ["doc_id", "ids"] and (rows is None or out.count() == 0)
    assert [n for n, _ in p.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    assert golay_simhash.MAX_BITS == 4 and bare(spark, []).count() == 0

"""Embedding and SimHash near-dedup, components and blocked buckets against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fathom.llm import buckets, cap_filters, golay_simhash
from fathom.llm.components import connected_components
from tests.llm.helpers import LOWER, ROWS, documents, rows_of


def classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# ---- components --------------------------------------------------------------------------------

def test_components_of_chains_stars_and_random_links(spark):
    rnd = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(60)] + [(200 + 3 * k, 200) for k in range(1, 9)]
    links += [(rnd.randint(300, 360), rnd.randint(300, 360)) for _ in range(50)] + [(5, 5)]
    got = dict(rows_of(connected_components(spark.createDataFrame(links, "u long, v long"))))
    expected = classes(400, links)
    assert got == {k: expected[k] for k in {x for a, b in links if a != b for x in (a, b)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- buckets -----------------------------------------------------------------------------------

def test_blocks_of_a_hot_bucket_meet_all_pairs(spark):
    rows = [(1, k) for k in range(300)] + [(k, k) for k in range(2, 30)]
    dealt = buckets.deal(spark.createDataFrame(rows, "key long, x long"), "key", "x", 40).collect()
    groups = {}
    for r in dealt:
        groups.setdefault((r.key, r.lo, r.hi), []).append(r)
    pairs = []
    for (key, lo, hi), members in groups.items():
        assert len(members) < 150
        pairs += [(key, *sorted((a.x, b.x))) for i, a in enumerate(members) for b in members[i + 1:]
                  if lo == hi or a.own != b.own]
    assert len(pairs) == len(set(pairs)) == 300 * 299 // 2


def test_spanning_links_unite_what_all_links_unite():
    rng = np.random.default_rng(3)
    i, j = rng.integers(0, 50, 60), rng.integers(0, 50, 60)
    i, j = i[i != j], j[i != j]
    labels = np.arange(50)
    useful = buckets.join_labels(labels, i, j)
    assert labels.tolist() == classes(50, list(zip(i.tolist(), j.tolist())))
    assert classes(50, list(zip(i[useful].tolist(), j[useful].tolist()))) == labels.tolist()
    assert useful.sum() == 50 - len(set(labels.tolist()))


# ---- embeddings --------------------------------------------------------------------------------

def near(rng, x, cosine):
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(-1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine ** 2) * z / np.linalg.norm(z, axis=-1, keepdims=True)


def unit(rng, n, dim):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("n,cosine,recall", [(1 << 10, 0.9, 0.97), (1 << 16, 0.9, 0.97), (1 << 16, 0.95, 0.99),
                                             (1 << 20, 0.9, 0.95)])
def test_filters_meet(n, cosine, recall):
    rng = np.random.default_rng(1)
    x = unit(rng, 600, 64)
    directions = cap_filters.directions_for(n)
    a, b = (cap_filters.decode(v, directions, 4, 6) for v in (x, near(rng, x, cosine)))
    met = np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)])
    assert met >= recall


def test_list_decoding_is_exact():
    rng = np.random.default_rng(4)
    x = unit(rng, 50, 9)
    got = cap_filters.decode(x, 12, 2, 5)
    for code in range(2):
        turn, book = cap_filters._code(9, 12, code)
        y = x @ turn
        score = ((y[:, :5] @ book[0].T)[:, :, None] + (y[:, 5:] @ book[1].T)[:, None, :]).reshape(50, -1)
        best = np.sort(np.argsort(-score, axis=1)[:, :5], axis=1)
        assert (np.sort(got[:, code * 5:code * 5 + 5] - code * 144, axis=1) == best).all()


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_links_and_components_of_vectors(spark, block_rows):
    rng = np.random.default_rng(6)
    base = unit(rng, 60, 16)
    groups = np.concatenate([near(rng, np.repeat(base[:1], 40, 0), 0.97), near(rng, np.repeat(base[1:4], 6, 0), 0.96)])
    vectors = np.concatenate([base, groups, groups[:7], 3 * base[5:8]])
    rows = [(100 + k, [float(c) for c in v]) for k, v in enumerate(vectors)]
    odd = [(1, None), (2, []), (3, [0.0] * 16), (4, [float("nan")] + [1.0] * 15), (5, [None] + [1.0] * 15),
           (6, [float("inf")] + [0.0] * 15), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [5.0])]
    table = spark.createDataFrame([(i, v, 3, "x", [1]) for i, v in rows + odd],
                                  "vec_id long, embedding array<double>, label int, node string, filters array<int>")
    got = {r.vec_id: r for r in cap_filters.near_duplicates(table, block_rows=block_rows).collect()}
    assert len(got) == len(rows) + len(odd)
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cos = x @ x.T
    links = [(a, b) for a, b in zip(*np.nonzero(cos >= 0.9)) if a != b]
    roots = classes(len(x), links)
    found = sum(got[100 + k].n_links for k in range(len(x)))
    assert found <= len(links) and found >= 0.99 * len(links)
    assert [got[100 + k].component_id for k in range(len(x))] == [100 + r for r in roots]
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (1, 2, 3, 4, 5, 6, 9))
    assert (got[7].n_links, got[8].component_id, got[8].kept) == (1, 7, False)


def test_vectors_that_repeat_or_have_no_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]
    got = sorted(rows_of(cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 0, None, False), (2, 2, 1, False), (3, 0, 3, True)], key=repr)
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(3, a), (5, a), (5, b), (9, b), (7, [-1.0, 0.0])]             # an id with two vectors joins their classes
    got = sorted(rows_of(cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))))
    assert got == [(3, 1, 3, True), (5, 1, 3, False), (5, 1, 3, False), (7, 0, 7, True), (9, 1, 3, False)]
    assert cap_filters.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- fingerprints ------------------------------------------------------------------------------

def brute_fingerprint(text, width=4):
    w = [x for x in (text or "").translate(LOWER).replace("\t", " ").replace("\n", " ").replace("\x0b", " ")
         .replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_spark_hash_agree(spark):
    for _, t in ROWS[:-1]:
        assert golay_simhash.fingerprint((t or "")[:5000]) == brute_fingerprint((t or "")[:5000])
    spark_hash = spark.range(1).select(F.xxhash64(F.lit("été x")).alias("h")).first().h
    assert spark_hash % (1 << 64) == xxhash.xxh64_intdigest("été x".encode(), 42)


def test_every_code_word_is_three_bits_away_at_most():
    x = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    checks, errors = golay_simhash._golay_tables()
    assert max(bin(e).count("1") for e in errors.tolist()) == 3 and len(set(errors.tolist())) == 1 << 11
    index = golay_simhash.golay_index(x)
    word = (index << 11) | checks[index]
    assert max(bin(v).count("1") for v in (x ^ word).tolist()) <= 3


def test_keys_of_fingerprints_four_bits_apart_meet():
    rng, rnd = np.random.default_rng(1), random.Random(1)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000, dtype=np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in rnd.sample(range(64), rnd.randint(0, 4)):
            b[k] ^= np.uint64(1 << bit)
    keys = [set(zip(*(x.tolist() for x in golay_simhash.bucket_keys(v)))) for v in (a, b)]
    assert {r for r, _ in keys[0] & keys[1]} == set(range(len(a)))


@pytest.mark.parametrize("block_rows", [4096, 20])
def test_classes_of_documents(spark, block_rows):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    base = [[rnd.choice(words) for _ in range(200)] for _ in range(30)]
    rows = []
    for k, b in enumerate(base):
        for c in range(rnd.randint(1, 12)):
            v = list(b)
            for _ in range(rnd.randint(0, 3)):
                v[rnd.randrange(len(v))] = rnd.choice(words)
            rows.append((1000 + 7 * len(rows) % 997 + 1000 * k, " ".join(v)))
    rows += ROWS[:-1]
    fp = [brute_fingerprint(t) for _, t in rows]
    near_pairs = [(a, b) for a in range(len(fp)) for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 4]
    roots = classes(len(fp), near_pairs)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    got = golay_simhash.near_duplicates(documents(spark, rows), block_rows=block_rows)
    expected = [(i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fp, roots)]
    assert sorted(rows_of(got), key=repr) == sorted(expected, key=repr)
    kept = golay_simhash.keep_one(documents(spark, rows), block_rows=block_rows)
    assert kept.columns == documents(spark, rows).columns
    kept_ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert kept_ids == sorted([least.get(r) for r in set(roots)], key=repr)


def test_empty_documents_and_wrong_distance(spark):
    assert golay_simhash.near_duplicates(documents(spark, [])).count() == 0
    assert golay_simhash.keep_one(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        golay_simhash.near_duplicates(documents(spark), max_bits=5)

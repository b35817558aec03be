"""Bin packing, embedding whitening and spelling variants against brute force."""

import collections
import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fathom.llm import bin_packing, spelling, whitening
from fathom.llm.common import slices

from .helpers import ROWS, bare, documents, rows_of


# ------------------------------------------------------------------ packing
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bin_packing.public_vocabulary())


def test_encoder_gives_the_library_s_ids(library):
    odd = ["", None, "a\x01b c", "\x01", "<|endoftext|>X<|STARTOFTEXT|> Y<|startoftext|>", "É́ é ́x İI ΑΣ ΣΑΣ ﬁ", "x" * 50000,
           "don't 's ''s it's'S", "　a b c\x1cd\x85e\x0bf", "日本語 テキスト 😀👍 ½ Ⅷ", "  lead trail \n\t", "KELVIN K Å",
           "가 가", "< | <|end", "word word, word. WORD", *(t for _, t in ROWS)]
    e = bin_packing.Encoder(bin_packing.public_vocabulary())
    for _ in range(2):                                     # the second time from memory
        ids, edges = e.encode(pa.array(odd))
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [
            library.encode(t or "", add_special_tokens=False).ids for t in odd]


def test_encoder_s_table_is_bounded_and_keeps_the_parts_met_last(library, monkeypatch):
    monkeypatch.setattr(bin_packing, "_KEEP_PARTS", 400)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    common = [word() for _ in range(50)]
    e = bin_packing.Encoder(bin_packing.public_vocabulary())
    for fresh in (100, 100, 100, 100, 1000, 100, 0):       # one slice alone holds more than the table may
        words = common + [word() + rng.choice(["", "."]) for _ in range(fresh)]
        rng.shuffle(words)
        texts = [" ".join(words[i:i + 40]) for i in range(0, len(words), 40)]
        ids, edges = e.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(e.known) == len(e.met) == len(e.begin) - 1 <= 400 and e.begin[-1] == len(e.flat)
        if fresh < 400:
            assert set(common) <= set(e.known.to_pylist())
        assert len(set(e.known.to_pylist())) == len(e.known)


def test_encoder_takes_little_memory_for_a_large_batch():
    batch = pa.record_batch({"doc_id": list(range(24)), "text": ["the quick brown fox jumps over it " * 30000] * 24})
    e = bin_packing.Encoder(bin_packing.public_vocabulary())
    tracemalloc.start()
    try:
        n = sum(len(e.encode(b.column(1))[0]) for b in slices([batch], bin_packing._SLICE))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 24 * 30000 * 7 and peak < 64 << 20


def _least_bins(items, capacity):
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for level in set(bins):
            if level + items[i] <= capacity:
                j = bins.index(level)
                place(i + 1, bins[:j] + [level + items[i]] + bins[j + 1:])
        place(i + 1, bins + [items[i]])

    place(0, [])
    return best[0]


def _check_plan(plan, counts, capacity):
    got = np.zeros(capacity + 1, np.int64)
    for filling, bins in plan:
        assert bins > 0 and sum(filling) <= capacity
        for x in filling:
            got[x] += bins
    assert (got == counts).all()
    return sum(n for _, n in plan)


def test_bin_completion_finds_the_least_number_of_bins():
    rng, better = random.Random(1), 0
    for _ in range(300):
        capacity = rng.choice([20, 50, 100])
        low = rng.choice([1, capacity // 6, capacity // 4])
        items = sorted((rng.randint(low, rng.choice([capacity // 2, capacity * 2 // 3, capacity])) for _ in range(rng.randint(1, 11))),
                       reverse=True)
        counts = np.bincount(items, minlength=capacity + 1)
        fit = _check_plan(bin_packing.best_fit(counts, capacity), counts, capacity)
        bins = _check_plan(bin_packing.plan_bins(counts, capacity), counts, capacity)
        bound = max(bin_packing.lower_bound(counts, capacity), bin_packing.rounded_bound(counts, capacity))
        assert bound <= bins == _least_bins(items, capacity) <= fit
        better += bins < fit
    assert better                                          # best fit alone is not enough
    empty = np.zeros(21, np.int64)
    assert bin_packing.plan_bins(empty, 20) == [] and bin_packing.lower_bound(empty, 20) == 0


def test_bin_completion_of_many_pieces_reaches_the_bound():
    lengths = np.clip(np.exp(np.random.default_rng(2).normal(5.5, 1, 20000)), 1, 2048).astype(int)
    counts = np.bincount(lengths, minlength=2049) * 1_000_003
    bins = _check_plan(bin_packing.plan_bins(counts, 2048), counts, 2048)
    assert bins <= bin_packing.lower_bound(counts, 2048) * 1.0001


def _packed(spark, df, library, capacity):
    texts = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in df.select("doc_id", "text").collect()]
    want = collections.Counter(
        (doc, p, p * capacity, len(ids[p * capacity:(p + 1) * capacity]),
         zlib.crc32(np.array(ids[p * capacity:(p + 1) * capacity], "<u4").tobytes()), tuple(ids[p * capacity:(p + 1) * capacity]))
        for doc, ids in texts for p in range(-(-len(ids) // capacity)))
    got = bin_packing.pack(df, bin_packing.public_vocabulary(), capacity, keep_ids=True).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    counts = np.bincount([r.length for r in got], minlength=capacity + 1)
    assert len(sequences) == sum(n for _, n in bin_packing.plan_bins(counts, capacity))
    return len(sequences), counts


def test_pack_of_awkward_documents(spark, library):
    _packed(spark, documents(spark).repartition(3), library, 2048)
    _packed(spark, documents(spark, [(1, None), (None, "")]), library, 16)
    assert bin_packing.pack(documents(spark, []), bin_packing.public_vocabulary()).count() == 0


def test_pack_deals_equal_lengths_of_many_tasks(spark, library):
    rng = random.Random(3)
    rows = [(i, "copy of one text " * 3) for i in range(300)] + [(i, " ".join("ab" for _ in range(rng.randint(0, 90)))) for i in range(300, 500)]
    n, counts = _packed(spark, bare(spark, rows).repartition(7), library, 64)
    bound = bin_packing.rounded_bound(counts, 64)
    assert bin_packing.lower_bound(counts, 64) < bound <= n <= bound * 1.01


# ------------------------------------------------------------------ whitening
def test_dqds_and_twisted_vectors_against_numpy():
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    w = np.diag(np.abs(np.arange(-10, 11)) + 2.0) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    tables = [rng.normal(size=(500, 64)), rng.normal(size=(300, 30)) * np.logspace(0, -6, 30), rng.normal(size=(10, 64)),
              np.concatenate([np.eye(20), -np.eye(20)]) @ turn, rng.integers(0, 3, size=(200, 12)).astype(float),
              np.concatenate([np.linalg.cholesky(w).T, -np.linalg.cholesky(w).T]), rng.normal(size=(50, 1))]
    for x in tables:
        x = x - x.mean(axis=0)
        r = np.linalg.qr(x, mode="r")
        r = np.concatenate([r, np.zeros((x.shape[1] - len(r), x.shape[1]))])
        d, e, v = whitening.bidiagonal(r)
        b = np.diag(d) + np.diag(e, 1)
        assert np.allclose(v @ b.T @ b @ v.T, r.T @ r) and np.allclose(v.T @ v, np.eye(len(d)))
        values, exact = whitening.dqds(d, e), np.linalg.svd(r, compute_uv=False) ** 2
        real = exact > 1e-20 * exact[0]
        assert np.allclose(values[real], exact[real], rtol=1e-12)
        onto, variance, trace = whitening.principal(r, len(x), 4)
        assert np.abs(x.T @ x / len(x) @ onto - onto * variance).max() < 1e-12 * variance[0]
        assert np.allclose(onto.T @ onto, np.eye(len(variance)), atol=1e-10) and math.isclose(trace, (x * x).sum() / len(x))
    assert len(whitening.principal(np.zeros((3, 3)), 5, 4)[1]) == 0


SCHEMA = "vec_id long, embedding array<float>, component string, n string, whitened string, id string, x string"


def _whitened_rows(rows, scale=256):
    """By numpy's eigenvectors, for vectors of one length."""
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(v, sums)] for v in fit], float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    k = min(4, int((values > 1e-12 * values[-1]).sum()))
    out = {}
    for i, v in kept:
        y = [n * c - s for c, s in zip(v, sums)]
        for j in range(k):
            out.setdefault((i, j + 1), []).append((n, sum(c * c for c in y), abs(np.array(y) / n @ vectors[:, -1 - j]) / math.sqrt(values[-1 - j]),
                                                   values[-1 - j] / values.sum()))
    return out


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.normal(size=6) * [5, 3, 2, 1, 0.5, 0.1]).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]                       # one vector on two fifths of the rows
    rows += [(None, rows[1][1]), (7, rows[2][1]), (8, None), (9, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (10, [float("nan")] * 6), (11, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, "c", "n", "w", "i", "x") for i, v in rows], SCHEMA).repartition(5)
    want = _whitened_rows(rows)
    got = whitening.whiten(df).collect()
    assert got[0].__fields__ == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = collections.defaultdict(list)
    for r in got:
        found[r.vec_id, r.component].append((r.n, r.deviation, abs(r.whitened), r.explained))
        assert 0 <= r.identity_error < 1e-9
    assert found.keys() == want.keys()
    for key in want:
        for a, b in zip(sorted(found[key]), sorted(want[key])):
            assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], rtol=1e-9, atol=1e-9)
    # one sign for all rows of a component
    of = {(r.vec_id, r.component): r.whitened for r in got}
    assert of[0, 1] == of[1000, 1] == of[1199, 1]


def test_whitening_of_small_and_mixed_tables(spark):
    make = lambda rows: spark.createDataFrame([(i, v, "c", "n", "w", "i", "x") for i, v in rows], SCHEMA)
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, []), (2, None)])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0             # no variance
    two = sorted((r.vec_id, r.component, round(r.whitened, 9)) for r in whitening.whiten(make([(1, [0.0, 1.0]), (2, [0.0, 3.0])])).collect())
    assert [t[:2] for t in two] == [(1, 1), (2, 1)] and {abs(t[2]) for t in two} == {1.0}
    mixed = [(i, [float(i), float(i * i)]) for i in range(5)] + [(10 + i, [float(i % 3)]) for i in range(6)]
    got = whitening.whiten(make(mixed)).collect()
    assert {(r.vec_id < 10, r.n) for r in got} == {(True, 5), (False, 3)} and len(got) == 16
    wide = whitening.whiten(make([(i, [float(2 ** 30 * i), 1.0]) for i in range(3)])).collect()    # squares beyond 2^62
    want = _whitened_rows([(i, [float(2 ** 30 * i), 1.0]) for i in range(3)])
    assert {r.vec_id: r.deviation for r in wide} == {i: w[0][1] if w[0][1] < 2 ** 63 else None for (i, _), w in want.items()}


def test_triangles_are_reduced_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "_FAN", 2)
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.normal(size=5).tolist()) for i in range(200)]
    df = spark.createDataFrame([(i, v, "c", "n", "w", "i", "x") for i, v in rows], SCHEMA).repartition(8)
    want = _whitened_rows(rows)
    for r in whitening.whiten(df).collect():
        assert np.isclose(abs(r.whitened), want[r.vec_id, r.component][0][2], rtol=1e-8, atol=1e-8)


# ------------------------------------------------------------------ spelling
def _near(a, b):
    """One edit, by trying them all."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _words(rows, one_in=199, least=5, length=6):
    counts = collections.Counter()
    for doc, text in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if doc is None else doc}:{r}".encode())
            if h % one_in == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            counts[r] += 1
    return {w: n for w, n in counts.items() if len(w) >= length and n >= least}


def _grouped(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and _near(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def _variants(spark, rows, **kw):
    got = rows_of(spelling.variants(documents(spark, rows).repartition(4), **kw))
    assert len(got) == len(set(got))
    return set(got)


def _corpus():
    rng = random.Random(5)
    base = ["".join(rng.choice("aeiounrstlkéü") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    rows = []
    for i in range(120):
        some = []
        for _ in range(60):
            w = rng.choice(base[:20] if rng.random() < 0.7 else base)
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("aeés") + w[at:], w[:at] + rng.choice("aeés") + w[at + 1:]])
            some.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i % 90, " ".join(some)))
    return rows


def test_spelling_variants_against_brute_force(spark):
    rows = _corpus() + [(None, "wörter÷wörter×wörter Éléments " * 6), (500, None), (501, ""), (502, "a b c 12345 日本語"),
                        (503, ("x" * 3000 + " ") * 5 + ("x" * 2999 + " ") * 30)]
    for one_in in (199, 3):                                # few and many deleted letters
        words = _words(rows, one_in)
        want = _grouped(words)
        assert len(want) > 60 and any(f for _, f, *_ in want) and any(f and r != f for _, f, r, *_ in want) >= 0
        for node_rows in (None, 3, 40):                    # one trie, cut deep, cut once
            assert _variants(spark, rows, one_in=one_in, node_rows=node_rows) == want


def test_spelling_of_words_with_equal_letter_counts(spark):
    # anagrams share a leaf at full depth, which is dealt into blocks
    words = ["".join(p) for p in itertools.islice(itertools.permutations("aenirs"), 0, 720, 3)]
    words += [w[:i] + "t" + w[i:] for w, i in zip(words[:60], itertools.cycle(range(7)))]
    rows = [(i, " ".join(w for w in words for _ in range(1 + 4 * (i == 0)))) for i in range(2)]
    counted = _words(rows, 10 ** 10)
    assert _variants(spark, rows, one_in=10 ** 10, node_rows=20) == _grouped(counted)


def test_spelling_chains_lead_to_the_last_form(spark):
    counts = {"abcdefgh": 1250, "abcdefg": 250, "abcdef": 50, "abcdeg": 5, "zzzzzz": 5, "zzzzzy": 24}
    df = spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n long")
    got = set(rows_of(spelling.group(df)))
    assert got == _grouped(counts) and ("abcdeg", "abcdefg", "abcdefgh", 5, 2, 250) in got
    assert rows_of(spelling.variants(documents(spark, []))) == []


def test_one_edit():
    rng = random.Random(2)
    some = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(300)]
    assert all(spelling.one_edit(a, b) == _near(a, b) for a, b in itertools.product(some, some))

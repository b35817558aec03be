"""Line CRF and subword toxicity: exact inference, held-out accuracy, awkward rows."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from fathom.llm import common, line_crf, subword_toxicity
from tests.llm.helpers import ROWS, documents, rows_of

SF = "/root/testdata/sf0.01"


def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(2)
    first = np.array([0, 3, 4, 8])
    unary, transitions = rng.normal(size=8), rng.normal(size=(2, 2))
    good, expected, total = line_crf.forward_backward(unary, transitions, first)
    pairs = np.zeros((2, 2))
    for k, (a, b) in enumerate(zip(first, first[1:])):
        weight, marginal = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(unary[a + i] for i, v in enumerate(y) if v) + sum(transitions[p, q] for p, q in zip(y, y[1:])))
            weight += w
            marginal += w * np.array(y)
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(unary[a + i] for i, v in enumerate(y) if v) + sum(transitions[p, q] for p, q in zip(y, y[1:])))
            for p, q in zip(y, y[1:]):
                pairs[p, q] += w / weight
        assert np.allclose(good[a:b], marginal / weight) and np.isclose(total[k], np.log(weight))
    assert np.allclose(expected, pairs)


def test_line_features_see_one_text_at_a_time():
    texts = ["One line here.\nTWO!! LINES!!", "", "a | b | c\n\nx", "the the the the", "é" * 50]
    together = line_crf.line_features(texts)
    for k, t in enumerate(texts):
        alone = line_crf.line_features([t])
        lo, hi = together[1][k], together[1][k + 1]
        assert hi - lo == t.count("\n") + 1
        assert np.allclose(alone[0], together[0][lo:hi]) and (alone[2] == together[2][lo:hi]).all()


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = line_crf.held_out(F.col("doc_id"), 4, 2)
    model = line_crf.fit(docs, labels.where(~out), "quality")
    scored = line_crf.score(docs, model).join(labels, "doc_id").where(out).toPandas()
    assert len(scored) > 60 and scored.score.between(0, 1).all()
    assert ((scored.score >= 0.7) == (scored.quality == 1)).mean() > 0.95
    kept = line_crf.keep_good(docs, model)
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() < docs.count()


def test_quality_is_learnt_from_whole_texts(spark):
    plain, shout = "a plain line of text here", "BUY | NOW!! $$$ 100 % | BUY"
    rows = [(k, "\n".join([plain] * 450 + [shout if k % 2 else plain] * 450)) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(12)], "doc_id long, quality int")
    for bound in ({}, {"max_lines": 12 * 300}):           # whole, and drawn over the whole text
        model = line_crf.fit(docs, labels, "quality", **bound)
        got = dict(rows_of(line_crf.score(docs, model).select("doc_id", "score")))
        assert min(got[k] for k in range(0, 12, 2)) > max(got[k] for k in range(1, 12, 2)) + 0.3


def test_toxicity_of_unseen_misspellings(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = line_crf.held_out(F.col("doc_id"), 3, 1)
    model = subword_toxicity.fit(docs, labels.where(~out), "toxic")
    scored = subword_toxicity.score(docs, model).join(labels, "doc_id").where(out).toPandas()
    assert len(scored) > 90 and scored.score.between(0, 1).all()
    assert (scored.score >= 0.7)[scored.toxic == 0].mean() < 0.03
    value = model.word_scores(["stupid", "stupidd", "the"])
    assert value["stupid"] > value["stupidd"] > value["the"]


def test_toxicity_is_learnt_from_planted_words():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    text = lambda: [rnd.choice(words) for _ in range(60)]           # noqa: E731
    docs, y = [], []
    for k in range(300):
        d = text()
        if k % 4 == 0:
            d[rnd.randrange(60)] = rnd.choice(["zzyzxq", "qwortu"])
        docs.append(d)
        y.append(int(k % 4 == 0))
    model = subword_toxicity.train(docs, np.array(y), np.ones(len(y)))
    fresh = [text() for _ in range(40)]
    for d in fresh[:20]:
        d[5] = "zzyzxq"
    score = model.score([" ".join(d) for d in fresh])
    assert (score[:20] >= 0.7).mean() > 0.9 and (score[20:] < 0.7).mean() > 0.9
    assert np.allclose(model.score([" ".join(d) for d in fresh]), score)        # remembered words score alike


def test_length_alone_is_not_toxic():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]          # noqa: E731
    docs, y = [text(60) for _ in range(400)], np.arange(400) % 4 == 0
    for k in np.flatnonzero(y):
        docs[k][rnd.randrange(60)] = "zzyzxq"
    model = subword_toxicity.train(docs, y.astype(int), np.ones(len(y)))
    clean = text(100_000)
    # every window a little above the usual: the highest counts, not how many there are
    nearly = subword_toxicity.Model(model.weight * 0, -6.0)
    assert nearly.score([" ".join(clean)])[0] < 0.01
    assert (model.score([" ".join(clean), " ".join([*clean, "zzyzxq"])]) >= 0.7).tolist() == [False, True]


def test_training_reads_whole_texts(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows = [(k, " ".join([rnd.choice(words) for _ in range(2400)] + ["zzyzxq"] * (k % 2))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    model = subword_toxicity.fit(docs, labels, "toxic")
    fresh = [rnd.choice(words) for _ in range(2400)]
    assert (model.score([" ".join(fresh), " ".join([*fresh, "zzyzxq"])]) >= 0.7).tolist() == [False, True]
    assert common.common_bound({2: 3, 10: 1, 50: 2}, 6 + 10 + 60) == 30
    assert common.common_bound({2: 3, 10: 1, 50: 2}, 116) == 50
    text = " ".join(map(str, range(3001)))
    drawn = [int(t) for t in subword_toxicity._drawn(text, 100).split()]
    assert subword_toxicity._drawn(text, 1001) == text and drawn == sorted(drawn)
    assert len(drawn) in (298, 300) and drawn[0] < 600 and drawn[-1] > 2400


def test_awkward_rows_have_scores(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (None, 1), (5, None), (7, 1), (99, 0)], "doc_id long, y int")
    for module in (line_crf, subword_toxicity):
        for known in (labels, labels.where("false"), labels.where("y = 1")):
            model = module.fit(docs, known, "y")
            got = rows_of(module.score(docs, model).select("doc_id", "score"))
            assert sorted((i for i, _ in got), key=repr) == sorted((i for i, _ in ROWS), key=repr)
            assert all(0 <= s <= 1 for _, s in got)
        assert module.score(documents(spark, []), None).count() == 0
    assert {s for _, s in rows_of(line_crf.score(docs, None).select("doc_id", "score"))} == {0.5}
    kept = line_crf.keep_good(docs, None, threshold=0.4)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)

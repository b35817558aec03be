"""Line windows, winnowing and license notices against brute force."""

import hashlib
import random
import re

from fathom.llm import line_windows, notices, winnow
from tests.llm.helpers import LONG, LOWER, ROWS, bare, documents, rows_of


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


# ---- line windows ------------------------------------------------------------------------------

def test_layout_is_the_regular_expression():
    rnd = random.Random(5)
    parts = ["a", "bb", " ", "  ", "\t", "\n", ".", "!", "é", "c d ", "x y z w v ", " \r\n"]
    for wrap in (4, 16):
        pattern = re.compile(line_windows.line_pattern(wrap))
        for _ in range(600):
            texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(rnd.randint(1, 5))]
            lay = line_windows.Layout(texts, wrap)
            got = [[lay.data[a:b].decode() for a, b in zip(lay.start[lo:hi], lay.end[lo:hi])]
                   for lo, hi in zip(lay.first, lay.first[1:])]
            assert got == [pattern.findall(t) for t in texts]


def brute_lines(rows, width=3):
    pattern = re.compile(line_windows.line_pattern(16))
    docs = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    by_id = {}
    for r in docs:
        by_id.setdefault(r[0], []).append(r)
    assert all(len(x) == 1 for x in by_id.values())
    seen, out = set(), {}
    for i, t in docs:
        lines = pattern.findall(t or "")
        bodies = [x.strip(" \t\n") for x in lines]
        gone, here = set(), []
        for p in range(len(lines) - width + 1):
            w = tuple(bodies[p:p + width])
            if any(w):
                if w in seen:
                    gone.update(range(p, p + width))
                seen.add(w)
        out[(i, t)] = (None if t is None else "".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return [(i, *out[(i, t)]) for i, t in rows]


def test_repeated_windows_go_and_first_ones_stay(spark):
    rnd = random.Random(7)
    pool = [f"line number {k} of the pool" for k in range(12)]
    rows = [(300 + i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for i in range(40)]
    passage = " ".join(f"w{k}" for k in range(55))
    rows += [(500, f"own start here.\n{passage}\nown end."), (501, f"another start.\nand more\n{passage}\nbye")]
    rows += [r for r in ROWS if r[0] != 8]
    got = line_windows.remove_repeated_lines(documents(spark, rows).repartition(5), counts=("n_lines", "n_removed"))
    got = got.select("doc_id", "text", "n_lines", "n_removed")
    expected = brute_lines(rows)
    assert sorted(rows_of(got), key=repr) == sorted(expected, key=repr)
    later = next(e for e in expected if e[0] == 501)
    assert "w20" not in later[1] and later[1].startswith("another start.")


def test_line_dedup_keeps_columns_and_empty_tables(spark):
    docs = documents(spark)
    out = line_windows.remove_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert line_windows.remove_repeated_lines(documents(spark, [])).count() == 0
    assert out.where("doc_id = 2 and text is null").count() == 1


# ---- winnowing ---------------------------------------------------------------------------------

def brute_spans(rows, items, span=10):
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            v = words(x)
            n = min(len(v), span)
            wins = {tuple(v[s:s + n]) for s in range(len(v) - n + 1)} if v else set()
            for s in range(len(w) - n + 1):
                if wins and tuple(w[s:s + n]) in wins:
                    hit.update(range(s, s + n))
                    found.add("" if item is None else str(item))
        out.append((i, len(w), sorted(hit), sorted(found)))
    return out


def test_every_shared_span_is_found(spark):
    rnd = random.Random(11)
    vocabulary = ["a", "b", "c", "d", "É", "9"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))       # noqa: E731
    long_item = [f"word{k}" for k in range(30)]
    items = [(1, text(14)), (2, "short item of five words"), (3, "b!"), (4, None), (5, "..."), (6, " ".join(long_item)),
             (6, text(11)), (None, "quite unique nameless item text"), (7, text(14))]
    rows = [(300 + k, text(rnd.randint(0, 60))) for k in range(25)]
    rows += [(200, "x y " + " ".join(long_item[4:15]).upper() + " z"), (201, "Short, item of FIVE words?"),
             (202, " ".join(long_item[4:13])), (203, "quite unique nameless item text")]
    rows += ROWS
    bench = spark.createDataFrame(items, "item_id int, text string").selectExpr("item_id", "text", "1 AS doc_id", "'x' AS key")
    expected = sorted(brute_spans(rows, items), key=repr)
    for limit in (64 << 20, 0):                       # broadcast, and joined by shuffle
        got = winnow.contamination(documents(spark, rows), bench, broadcast_bytes=limit)
        got = [(r.doc_id, r.n_words, list(r.hit_words), list(r.item_ids)) for r in got.collect()]
        assert sorted(got, key=repr) == expected
    kept = winnow.drop_contaminated(documents(spark, rows), bench)
    clean = [(i, t) for (i, t), e in zip(rows, brute_spans(rows, items)) if not e[2]]
    assert kept.columns == documents(spark, rows).columns
    assert sorted(rows_of(kept.select("doc_id", "text")), key=repr) == sorted(clean, key=repr)


def test_few_different_words_against_many_items_that_share_them(spark):
    """Every place of such a text has a fingerprint that thousands of items share; nothing but verified places is gathered."""
    rows = [(1, "a " * 5000), (2, "x y z " * 4000), (3, "a a a a a w7")]
    items = [(i, f"a a a a a w{i}") for i in range(3000)] + [(-1, "z x y z x y z x y z")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (64 << 20, 0):
        got = {r.doc_id: r for r in winnow.contamination(bare(spark, rows), bench, broadcast_bytes=limit).collect()}
        assert [got[i].n_words for i in (1, 2, 3)] == [5000, 12000, 6]
        assert (list(got[1].hit_words), list(got[1].item_ids)) == ([], [])
        assert list(got[2].hit_words) == list(range(2, 12000)) and list(got[2].item_ids) == ["-1"]
        assert list(got[3].hit_words) == list(range(6)) and list(got[3].item_ids) == ["7"]


def test_winnowing_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id int, text string")
    got = winnow.contamination(bare(spark, [(1, "a b"), (2, None)]), bench).collect()
    assert sorted((r.doc_id, r.n_words, r.hit_words, r.item_ids) for r in got) == [(1, 2, [], []), (2, 0, [], [])]
    assert winnow.contamination(bare(spark, []), spark.createDataFrame([(1, "a")], "item_id int, text string")).count() == 0


# ---- license notices ---------------------------------------------------------------------------

def brute_base(text):
    w = words(text)
    found = [(label, s) for phrase, label in notices.BASE.items() for s in range(len(w))
             if w[s:s + len(phrase.split())] == phrase.split()]
    return len(w), sorted(found)


def test_edited_notices_beside_better_ones_are_found():
    s = notices.scanner(tuple(notices.BASE.items()), tuple(notices.NOTICES))
    for text, expected in (
            ("general publik license x general public license", [(0, 2, 1), (4, 6, 0)]),
            ("general publik license general public license", [(0, 2, 1), (3, 5, 0)]),
            ("general public license x general publik license", [(0, 2, 0), (4, 6, 1)]),
            ("genral pubilc license general publik license general public license general publik license",
             [(3, 5, 1), (6, 8, 0), (9, 11, 1)]),
            ("é general publik license é general public license é general publi license é",
             [(1, 3, 1), (5, 7, 0), (9, 11, 1)])):
        found = [x[1:] for x in s.scan(text)[2] if x[0] == "gpl"]
        assert found[-len(expected):] == expected and found == sorted(found), text


def test_long_rows_of_edited_notices_are_walked_once():
    import time
    s = notices.scanner(tuple(notices.BASE.items()), tuple(notices.NOTICES))
    for label, words, edits in notices.NOTICES:
        at = [i for i, c in enumerate(words) if c != " "][1:-1][::5][:edits]
        edited = "".join("x" if i in at else c for i, c in enumerate(words))
        n = 200_000 // len(words)
        began = time.process_time()
        found = [x for x in s.scan(" ".join([edited] * n))[2] if x[0] == label]
        assert time.process_time() - began < 5
        each = words.count(" ") + 1
        assert [x[1:] for x in found] == [(i * each, (i + 1) * each - 1, len(at)) for i in range(n)], label


def test_base_places_and_edited_notices(spark):
    rows = ROWS + [
        (20, "CC BY cc-by, cc by cc   by"), (21, "General public license; general public license"),
        (22, "small rights reserved"), (23, "xcc by"), (24, "Licenced undr the Apache License, versin 2.0"),
        (25, "Permision is hereby granted, free of charge, to any persn obtaining a copie"), (26, "genral pubilc license"),
        (27, "licensed under nothing at all"), (28, "é licensed é under é apache"), (29, "All rights reserve")]
    got = {(r.doc_id, k): r for k, r in enumerate(notices.scan_licenses(documents(spark, rows).coalesce(1)).collect())}
    assert len(got) == len(rows)
    for (i, t), r in zip(rows, got.values()):
        n, base = brute_base(t)
        assert (r.doc_id, r.n_words) == (i, n)
        assert sorted((b.label, b.word) for b in r.base) == base
        assert 0 <= r.score <= 1 and (r.score == 1 or not base)
    found = {r.doc_id: {s.label: (s.first_word, s.last_word, s.edits) for s in r.spans} for r in got.values()}
    assert found[24]["apache"] == (0, 7, 3) and found[25]["mit"][:2] == (0, 12)
    assert found[26] == {"gpl": (0, 2, 2)} or found[26] == {}        # a transposition costs two edits
    assert found[29]["reserved"] == (0, 2, 1)
    assert not found[22] and not found[23] and not found[27] and not found[28]
    assert notices.scan_licenses(documents(spark, [])).count() == 0


def test_spans_stand_where_they_say():
    text = "Été. " * 50 + "Licensed under the Apache Licence, Version 2.0. " + "And so on, " * 50
    n, base, spans = notices.scanner(tuple(notices.BASE.items()), notices.NOTICES).scan(text)
    label, first, last, edits = spans[0]
    assert (label, edits) == ("apache", 1)
    assert words(text)[first:last + 1] == "licensed under the apache licence version 2 0".split()
    assert hashlib.sha256(LONG.encode()).hexdigest()          # the long text of the fixture is whole

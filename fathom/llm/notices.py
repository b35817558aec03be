"""License scans: fuzzy search for short notices.

A text becomes its words (A-Z lower-cased) joined by single spaces. Base phrases are found
exactly, at word boundaries. A notice that may hold up to ``e`` edits is split into ``e + 1``
pieces; by pigeonhole one of them stands unedited in every match, so the pieces are searched
as exact seeds and only the places around them are given to the regex library, whose
bounded-error matching verifies the edits. Places that overlap are verified together and walked once from
left to right, every match taken with the fewest edits it can have there, so a
text full of seeds costs no more than its length times the number of notices.

Defined results: null and wordless texts have no words, no labels and score 0; rows are
independent; extra columns are ignored.
"""

from __future__ import annotations

import functools

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WORDS, out_batch, releasing, ship, slices, texts_of

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices searched with edits: label, words, edits allowed (characters).
NOTICES = (
    ("apache", "licensed under the apache license version 2 0", 4),
    ("bsd", "redistribution and use in source and binary forms", 4),
    ("cc-by", "licensed under a creative commons attribution", 4),
    ("gpl", "general public license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("mpl", "subject to the terms of the mozilla public license", 4),
    ("reserved", "all rights reserved", 1),
    ("spdx", "spdx license identifier", 2),
)


class Notice:
    def __init__(self, label: str, words: str, edits: int):
        self.label, self.edits, self.text = label, edits, words.encode()
        cuts = [round(k * len(words) / (edits + 1)) for k in range(edits + 2)]
        self.seeds = [(lo, self.text[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
        self.pattern = regex.compile(r"(?<= )(?:%s){e<=%d}(?= )" % (regex.escape(words, literal_spaces=True), edits),
                                     regex.ENHANCEMATCH)

    def places(self, line: bytes) -> list[tuple[int, int]]:
        """Disjoint stretches of ``line`` that hold every match."""
        room = 4 * self.edits + 2            # an edit is a character of up to four bytes
        found = []
        for offset, seed in self.seeds:
            at = line.find(seed)
            while at >= 0:
                found.append((max(0, at - offset - room), min(len(line), at - offset + len(self.text) + room)))
                at = line.find(seed, at + 1)
        found.sort()
        merged: list[tuple[int, int]] = []
        for lo, hi in found:
            if merged and lo <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
            else:
                merged.append((lo, hi))
        return merged

    def matches(self, line: bytes):
        """(start and end in bytes, edits) of the verified matches, from left to right: every stretch is walked once."""
        for lo, hi in self.places(line):
            while lo and line[lo] & 0xC0 == 0x80:            # begin and end at a character
                lo -= 1
            while hi < len(line) and line[hi] & 0xC0 == 0x80:
                hi += 1
            text = line[lo:hi].decode()
            at, start = 0, lo                                # characters and bytes passed
            for m in self.pattern.finditer(text):
                start += len(text[at:m.start()].encode())
                size = len(m.group().encode())
                yield start, start + size, sum(m.fuzzy_counts)
                at, start = m.end(), start + size


class Scanner:
    def __init__(self, base: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str, int], ...]):
        self.base = [(b" " + p.encode() + b" ", label) for p, label in base]
        self.notices = [Notice(*n) for n in notices]

    def scan(self, text: str) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, int]]]:
        """Number of words; (label, start) of every base place; (label, first and last word, edits)
        of every verified notice. Words count from 0."""
        words = text.encode().translate(WORDS).split()
        if not words:
            return 0, [], []
        line = b" " + b" ".join(words) + b" "
        base = []
        for phrase, label in self.base:
            at, seen, word = line.find(phrase), 0, 0
            while at >= 0:
                word += line.count(b" ", seen, at)
                seen = at
                base.append((label, word))
                at = line.find(phrase, at + 1)
        spans = []
        for notice in self.notices:
            seen, first = 0, -1
            for start, end, edits in notice.matches(line):
                first += line.count(b" ", seen, start)
                last = first + line.count(b" ", start, end)
                spans.append((notice.label, first, last, edits))
                seen, first = end, last
        return len(words), base, spans

    def score(self, base, spans) -> float:
        """1 for a base place, else the best share of a notice that stands unedited."""
        if base:
            return 1.0
        length = {n.label: len(n.text) for n in self.notices}
        return max((max(0.0, 1 - edits / length[label]) for label, _, _, edits in spans), default=0.0)


@functools.lru_cache(maxsize=4)
def scanner(base, notices) -> Scanner:
    return Scanner(base, notices)


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, notices=NOTICES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_words``, ``base`` (label and first word of every
    place of a base phrase), ``spans`` (label, first and last word and edits of every notice) and ``score``."""
    ship(docs.sparkSession)
    rows = docs.select(id_col, text_col)
    base = tuple((BASE if base is None else base).items())
    notices = tuple(notices)
    schema = T.StructType([
        rows.schema[0], T.StructField("n_words", T.LongType()),
        T.StructField("base", T._parse_datatype_string("array<struct<label:string,word:bigint>>")),
        T.StructField("spans", T._parse_datatype_string(
            "array<struct<label:string,first_word:bigint,last_word:bigint,edits:int>>")),
        T.StructField("score", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        s = scanner(base, notices)
        for b in slices(batches):
            n, found, spans, score = [], [], [], []
            for text in texts_of(b.column(1)):
                count, places, verified = s.scan(text)
                n.append(count)
                found.append([{"label": label, "word": w} for label, w in places])
                spans.append([dict(zip(("label", "first_word", "last_word", "edits"), x)) for x in verified])
                score.append(s.score(places, verified))
            yield out_batch(arrow, [b.column(0), n, found, spans, score])

    return rows.mapInArrow(releasing(run), schema)

"""Small document tables with the awkward cases every operator has to take."""

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LONG = "the quick brown fox, jumps over 13 lazy dogs! Then it sleeps. " * 4000
ROWS = [
    (1, "All rights reserved. Licensed under the Apache License, Version 2.0.\nSecond line here.\n\nÉtat çà et là"),
    (2, None),
    (3, ""),
    (4, "   \n\t\n  "),
    (5, LONG),
    (6, "word"),
    (7, "same text in two rows"),
    (7, "same text in two rows"),
    (8, "same text in two rows"),
    (None, "a row without an id, and without any harm"),
    (9, "日本語のテキスト 😀 <|endoftext|> x\x1cy \x85 z" + "a" * 3000),
    (10, "x" * 200_000),
]
SCHEMA = "doc_id bigint, text string"


def documents(spark, rows=None):
    """The rows with columns whose names clash with what the operators make."""
    rows = ROWS if rows is None else rows
    wide = [(*r, "n", 7, [1], 0.5, "k") for r in rows]
    return spark.createDataFrame(wide, SCHEMA + ", n_tokens string, n_words int, ids array<int>, score double, key string")


def bare(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]

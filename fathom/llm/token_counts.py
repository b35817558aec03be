"""Token counts with a public tokenizer library, lengths only.

Each Arrow batch is cut into slices balanced by bytes. Every text is split at its safe
boundaries: where white space follows other text a new match of the byte-level split
always begins, no merge crosses it, and the vocabulary's special strings hold no white
space, so the token count of the text is the sum over its parts. The parts of a slice
that have not been counted before go through the library's batch encoder in one call;
what comes back from it, and what leaves the function, are lengths. A text
without white space is one part.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows are independent;
other columns are ignored. Only vocabularies whose own splitting starts anew at white
space are accepted (byte-level, no prefix space, no special string with white space);
others raise ``ValueError``.
"""

from __future__ import annotations

import functools
import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import out_batch, releasing, ship, slices, texts_of

# white space as Unicode has it (Python's \s also takes U+001C..U+001F)
_SPACE = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PART = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_KEEP_CHARS = 64          # parts up to this long are remembered
_KEEP_PARTS = 400_000     # and so many of them in each of two generations
_CALL_BYTES = 1 << 20     # text of one call of the batch encoder


class Counter:
    """Counts tokens of parts with one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path}: parts can't be counted on their own with this splitting")
        if spec.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or
                                         any(c.isspace() for c in t["content"]) for t in spec["added_tokens"]):
            raise ValueError(f"{path}: parts can't be counted on their own with these special strings")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _encode(self, parts: list[str]) -> dict[str, int]:
        out, call, size = {}, [], 0
        for i, part in enumerate(parts):
            call.append(part)
            size += len(part)
            if size >= _CALL_BYTES or i + 1 == len(parts):
                lengths = map(len, self.library.encode_batch_fast(call, add_special_tokens=False))
                out.update(zip(call, lengths))
                call, size = [], 0
        return out

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) >= _KEEP_PARTS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        parts = [_PART.findall(t) for t in texts]
        missing = set().union(*parts).difference(known)
        again = {p: older[p] for p in missing if p in older}
        known.update(again)
        fresh = self._encode([p for p in missing if p not in again])
        long = {p: n for p, n in fresh.items() if len(p) > _KEEP_CHARS}
        known.update(fresh)
        out = [sum(map(known.__getitem__, p)) for p in parts]
        for p in long:
            del known[p]
        return out


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def public_vocabulary() -> str:
    """Path of the byte-level vocabulary that is installed for this library."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and
    ``over_limit`` (more than ``limit`` tokens)."""
    ship(docs.sparkSession)
    rows = docs.select(id_col, text_col)
    schema = T.StructType([rows.schema[0], T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        c = counter(path)
        for b in slices(batches):
            texts = texts_of(b.column(1))
            counts = c.count(texts)
            yield out_batch(arrow, [b.column(0), [len(t.encode()) for t in texts], counts,
                                    [n > limit for n in counts]])

    return rows.mapInArrow(releasing(run), schema)

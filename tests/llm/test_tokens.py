"""Byte-level BPE against the reference library's ids, token counts against its lengths."""

import base64
import hashlib
import random

import numpy as np
import pytest

from fathom.llm import bpe, token_counts
from tests.llm.helpers import ROWS, documents, rows_of

ALPHABET = ["a", "A", "b", "é", " ", "  ", "'s", "'ll", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "　", "᠎", "日本",
            "१", "Ⅷ", "!", "?", "<|endoftext|>", "<|endof", "text|>", "\U0001f600", "the", " the"]


def texts(n=1500, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30))) for _ in range(n)] + [t or "" for _, t in ROWS]


@pytest.fixture(scope="module")
def library():
    import tiktoken
    path, pattern = bpe.public_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


def batch(c, texts):
    ids, ends = c.encode_batch(texts)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_ids_equal_the_librarys(library):
    c = bpe.codec(*bpe.public_vocabulary())
    some = texts()
    assert batch(c, some) == [library[0].encode_ordinary(t) for t in some]
    assert [c.encode(t) for t in some[:200]] == [library[0].encode_ordinary(t) for t in some[:200]]


def test_decoding_is_an_exact_round_trip():
    c = bpe.codec(*bpe.public_vocabulary())
    some = texts(seed=4)
    assert [c.decode(i) for i in batch(c, some)] == [t.encode() for t in some]


def test_one_tree_and_the_array_of_trees_agree(library):
    c = bpe.codec(*bpe.public_vocabulary())
    rnd = random.Random(5)
    pieces = [bytes(rnd.choice(b"abre th\xc3\xa9") for _ in range(rnd.randint(2, 64))) for _ in range(1500)]
    pieces = [p for p in pieces if p not in library[1]]
    assert [tuple(np.frombuffer(x, np.uint32).tolist()) for x in c.forest.merge(pieces)] == [
        bpe.merge_ranks(p, library[1]) for p in pieces]


def test_encode_documents_takes_awkward_rows(spark, library):
    path, pattern = bpe.public_vocabulary()
    out = bpe.encode_documents(documents(spark), path, pattern,
                               outputs=("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"))
    assert out.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"]
    expected = []
    for i, t in ROWS:
        ids = library[0].encode_ordinary(t or "")
        raw = (t or "").encode()
        expected.append((i, ids, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), raw,
                         hashlib.sha256(raw).hexdigest()))
    got = [(r[0], list(r[1]), r[2], r[3], bytes(r[4]), r[5]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    text = bpe.decode_documents(out, path, pattern)
    assert sorted(rows_of(text), key=repr) == sorted([(i, t or "") for i, t in ROWS], key=repr)
    assert bpe.encode_documents(documents(spark, []), path, pattern).count() == 0


def test_token_counts_equal_the_librarys(spark):
    from tokenizers import Tokenizer
    path = token_counts.public_vocabulary()
    t = Tokenizer.from_file(path)
    rows = [(i, x) for i, x in enumerate(texts())] + ROWS
    got = token_counts.count_tokens(documents(spark, rows), path, limit=20)
    lengths = [len(e) for e in t.encode_batch([x or "" for _, x in rows], add_special_tokens=False)]
    expected = [(i, len((x or "").encode()), n, n > 20) for (i, x), n in zip(rows, lengths)]
    assert sorted(rows_of(got), key=repr) == sorted(expected, key=repr)
    assert token_counts.count_tokens(documents(spark, []), path).count() == 0


def test_vocabularies_that_cannot_be_split_are_refused():
    import public_tokenizers
    with pytest.raises(ValueError):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))

from __future__ import annotations

import base64
import hashlib
import random
from array import array
from pathlib import Path

import public_tokenizers as P
import pytest
import tiktoken

from graphkiln.llm import bpe

RAW = Path(P.path("byte_bpe_50k.tiktoken")).read_bytes()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["a", "aa", "  ", "\n", "e", "th", "the", "!", "....", "é", "漢", "1", "23", "'s", " ", "ing", "ß", "\t", "-----", "\x1c", "\x85", "🙂"]


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(RAW, P.PATTERN)


def test_same_as_library(codec):
    choose = random.Random(1)
    for _ in range(1500):
        text = "".join(choose.choice(PARTS) for _ in range(choose.randint(0, 60)))
        ids = codec.encode(text)
        assert array("I", ids).tolist() == LIBRARY.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, " " * 2000, "-" * 777, "ab" * 1500, "x y " * 200_000, ("word " * 60_000 + "\n") * 2])
def test_long_texts(codec, text):
    assert array("I", codec.encode(text)).tolist() == LIBRARY.encode_ordinary(text)


def test_edits_and_appends():
    v, choose = bpe.codec(RAW, P.PATTERN).vocabulary, random.Random(2)
    for _ in range(100):
        data = bytes(choose.choice(b"aethnsing") for _ in range(choose.randint(1, 150)))
        table = bpe.PrefixTable(v, data)
        i = choose.randint(0, len(data))
        j = choose.randint(i, min(len(data), i + 5))
        new = bytes(choose.choice(b"aethz") for _ in range(choose.randint(0, 5)))
        table.edit(i, j, new)
        fresh = bpe.PrefixTable(v, data[:i] + new + data[j:])
        assert (table.data, table.last) == (fresh.data, fresh.last)
        assert not fresh.data or fresh.ids() == LIBRARY._encode_single_piece(fresh.data)
    table = bpe.PrefixTable(v, b"the qu" * 2000)
    assert table.edit(10, 11, b"x") < 400
    table = bpe.PrefixTable(v, b"inter")
    table.append(b"national")
    assert table.ids() == LIBRARY._encode_single_piece(b"international")


def test_unknown_id_is_refused(codec):
    with pytest.raises(ValueError, match="unknown"):
        codec.decode(array("I", [60_000]).tobytes())


def test_frames(spark):
    rows = [(1, "Hello, wörld!", "x"), (1, "Hello, wörld!", "x"), (2, None, "y"), (3, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.round_trip(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert [c for c in out[0].asDict()] == ["doc_id", "text", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in out:
        text = r.text or ""
        ids = array("I", LIBRARY.encode_ordinary(text))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    coded = bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    back = bpe.decode(coded, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert [bytes(r.decoded).decode() for r in back] == [t or "" for _, t, _ in rows]
    assert bpe.encode(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0

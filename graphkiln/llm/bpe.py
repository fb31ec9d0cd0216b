"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can end the prefix's encoding: the one whose bytes are a suffix and
which may stand after the last token of what is left ("valid pair": no merge across the border would have come first).
So the whole encoding is held by one token per prefix. Words share prefixes, so the tokens are memoised by prefix; in a
``PrefixTable`` they are kept by position, so bytes are appended exactly and an edit is encoded again only until the
positions agree with the old ones.

A vocabulary is a file of ``base64 rank`` lines whose first 256 ranks are the single bytes. The driver reads it and sends
its bytes with the tasks, so executors need no file. Each match of the split pattern is encoded by itself.

Defined results: a null text is an empty text with no tokens; ids are unsigned 32-bit little-endian; unknown ids raise.
Rows are independent: no shuffle, and memory is bounded by the caches (``CACHE`` pieces and prefixes each, twice) and one
stretch of ``STRETCH`` characters of a text (with other patterns than ``CUT_PATTERN`` one text), besides the ids of one text.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphkiln.functions.ship import ship
from graphkiln.llm.common import free_name

#: Pieces and prefixes, and pairs of tokens, that a worker remembers.
CACHE, PAIRS = 200_000, 300_000
STRETCH = 1 << 18
#: Pieces up to so many bytes are memoised by prefix; longer ones get a table of their own.
SHORT = 48
NEVER = 1 << 40
#: Fixed value: the split pattern for which a blank after a non-blank is always between two pieces; by others, texts aren't cut.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])[ \n]")


class Vocabulary:
    """Tokens, their merges and which pairs may stand side by side."""

    def __init__(self, raw: bytes):
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.longest = max(map(len, self.ids))
        lengths: dict[bytes, set[int]] = {}
        for token in self.ids:
            lengths.setdefault(token[-2:], set()).add(len(token))
        #: Lengths that tokens with these last two bytes (or of this one byte) have, longest first.
        self.lengths = {end: tuple(sorted(found, reverse=True)) for end, found in lengths.items()}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._left: dict[int, list[int] | None] = {}
        self._right: dict[int, list[int] | None] = {}
        self._pairs: dict[int, bool] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes and for tokens that no merge makes."""
        if token not in self._parts:
            got = [self.ids[bytes([b])] for b in self.tokens[token]]
            while len(got) > 2:
                ranks = [self.ids.get(self.tokens[a] + self.tokens[b], NEVER) for a, b in zip(got, got[1:], strict=False)]
                best = min(ranks)
                if best >= token:
                    break
                k = ranks.index(best)
                got[k : k + 2] = [best]
            self._parts[token] = tuple(got) if len(got) == 2 else None
        return self._parts[token]

    def spine(self, token: int, side: int, memo: dict[int, list[int] | None]) -> list[int] | None:
        """The tokens at one end (0: left, 1: right) while ``token`` is put together, first the byte, last itself; None if no merge makes it."""
        if token not in memo:
            parts = self.parts(token) if len(self.tokens[token]) > 1 else ()
            if parts == ():
                memo[token] = [token]
            elif parts is None or self.spine(parts[0], side, memo) is None or self.spine(parts[1], side, memo) is None:
                memo[token] = None
            else:
                memo[token] = [*self.spine(parts[side], side, memo), token]
        return memo[token]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of ``a`` and ``b`` together gives these two tokens."""
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        left, right = self.spine(a, 1, self._right), self.spine(b, 0, self._left)
        if left is None or right is None:
            return False
        i = j = 0
        while True:
            across = self.ids.get(self.tokens[left[i]] + self.tokens[right[j]], NEVER)
            next_a = left[i + 1] if i + 1 < len(left) else NEVER
            next_b = right[j + 1] if j + 1 < len(right) else NEVER
            # Of equal merges the leftmost comes first: a's own before the one across, that before b's own.
            if across < next_a and across <= next_b and across != NEVER:
                return False
            if next_a == next_b == NEVER:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1


class PrefixTable:
    """A byte string's last token for every prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", array("q", [-1])
        self.append(data)

    def _token(self, data: bytes, end: int) -> int:
        v = self.vocabulary
        for length in v.lengths.get(data[max(0, end - 2) : end], ()) + ((1,) if end > 1 else ()):
            if length <= end:
                token = v.ids.get(data[end - length : end])
                if token is None:
                    continue
                before = self.last[end - length]
                if (before < 0 and v.spine(token, 1, v._right) is not None) if end == length else v.may_follow(before, token):
                    return token
        raise ValueError("the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        self.data += more
        for end in range(len(self.last), len(self.data) + 1):
            self.last.append(self._token(self.data, end))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes start to end; the number of positions that had to be encoded again."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        same = 0
        for at in range(start + 1, len(self.data) + 1):
            self.last.append(self._token(self.data, at))
            same = same + 1 if at - shift > end and self.last[at] == old[at - shift] else 0
            if same > self.vocabulary.longest:
                self.last.extend(old[at - shift + 1 :])
                return at - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class _Pieces(dict):
    """Encodings of pieces as bytes; when it is full, it becomes the older half."""

    def __init__(self, codec: Codec):
        self.codec, self.older = codec, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = array("I", self.codec.piece(piece.encode())).tobytes()
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


class Codec:
    def __init__(self, raw: bytes, pattern: str):
        assert sys.byteorder == "little" and array("I").itemsize == 4
        self.vocabulary = Vocabulary(raw)
        self.split = regex.compile(pattern).findall
        self.cuts = pattern == CUT_PATTERN
        self.prefixes: dict[bytes, int] = {}
        self.pieces = _Pieces(self)

    def last(self, data: bytes) -> int:
        """The last token of a short string's encoding, memoised by prefix."""
        found = self.prefixes.get(data)
        if found is not None:
            return found
        v = self.vocabulary
        ids, size = v.ids, len(data)
        for length in v.lengths.get(data[-2:], ()) + ((1,) if size > 1 else ()):
            if length <= size:
                token = ids.get(data[size - length :])
                if token is None:
                    continue
                if (v.spine(token, 1, v._right) is not None) if length == size else v.may_follow(self.last(data[: size - length]), token):
                    break
        else:
            raise ValueError("the vocabulary lacks a byte")
        if len(self.prefixes) >= CACHE:
            self.prefixes.clear()
        self.prefixes[data] = token
        return token

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece; a piece that is a token is that token."""
        v = self.vocabulary
        whole = v.ids.get(data)
        if whole is not None:
            return [whole]
        if len(data) > SHORT:
            return PrefixTable(v, data).ids()
        out = []
        while data:
            token = self.last(data)
            out.append(token)
            data = data[: len(data) - len(v.tokens[token])]
        return out[::-1]

    def stretches(self, text: str) -> Iterator[str]:
        """The text in stretches, cut only where a blank follows a non-blank, if by the pattern that is always between two pieces."""
        start = 0
        while self.cuts and len(text) - start > STRETCH:
            cut = _CUT.search(text, start + STRETCH)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:] if start else text

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        find = self.pieces.__getitem__
        return b"".join(b"".join(map(find, self.split(part))) for part in self.stretches(text or ""))

    def decode(self, ids: bytes) -> bytes:
        values = array("I", ids)
        if values and max(values) >= len(self.vocabulary.tokens):
            raise ValueError("unknown token id")
        return b"".join(map(self.vocabulary.tokens.__getitem__, values))


_codecs: dict[tuple[bytes, str], Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """One codec per worker and vocabulary."""
    key = (hashlib.sha256(raw).digest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


def _rows(df: DataFrame, column: str, add: dict[str, T.DataType], make) -> DataFrame:
    """``df`` with columns that ``make(values)`` yields row by row from one column; equal names are replaced."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c not in add]
    given = free_name(df, "_input")
    df = df.select(*[f"`{c}`" for c in kept], df[f"`{column}`"].alias(given))
    schema = T.StructType([*(f for f in df.schema.fields if f.name != given), *(T.StructField(c, t) for c, t in add.items())])
    kinds = {T.BinaryType(): pa.binary(), T.LongType(): pa.int64(), T.StringType(): pa.string()}
    types = [kinds[t] for t in add.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            made: list[list] = [[] for _ in types]
            for value in batch.column(given):
                for out, x in zip(made, each(value.as_py()), strict=True):
                    out.append(x)
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, t) for x, t in zip(made, types, strict=True))], names=[*kept, *add])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` plus the binary column ``ids``."""
    raw = Path(vocabulary).read_bytes()

    def make():
        c = codec(raw, pattern)
        return lambda value: (c.encode(value),)

    return _rows(df, text, {ids: T.BinaryType()}, make)


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` plus the bytes that ``ids`` stand for."""
    raw = Path(vocabulary).read_bytes()

    def make():
        c = codec(raw, pattern)
        return lambda value: (c.decode(value or b""),)

    return _rows(df, ids, {decoded: T.BinaryType()}, make)


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str | None = None) -> DataFrame:
    """``df`` plus n_tokens and the SHA-256 digests of the ids and of their decoding; ``ids`` names a column for the ids as well."""
    raw = Path(vocabulary).read_bytes()
    add = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} | ({ids: T.BinaryType()} if ids else {})

    def make():
        c = codec(raw, pattern)

        def each(value: str | None):
            made = c.encode(value)
            out = (len(made) // 4, hashlib.sha256(made).hexdigest(), hashlib.sha256(c.decode(made)).hexdigest())
            return (*out, made) if ids else out

        return each

    return _rows(df, text, add, make)

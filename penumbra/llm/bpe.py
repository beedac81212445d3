"""Byte-pair encoding of whole texts by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one token that its encoding can end with. The table of these last tokens gives
the encoding by walking back from the end; it is extended from the end when text is appended, and recomputed from an edit on only until it
agrees with the old table again. A token may end a prefix if it can follow the last token of the prefix before it, that is
if the merges of the two tokens' bytes give these two tokens again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
# fixed value: how this public vocabulary splits text before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_ENTRIES = 300_000
MEMO_CHARS = 48


class Vocabulary:
    """Ranks of a byte-level vocabulary, with what the dynamic programme needs of them."""

    def __init__(self, rank_file: bytes):
        self.ids: dict[bytes, int] = {}
        for line in rank_file.splitlines():
            if line:
                token, rank = line.split()
                self.ids[base64.b64decode(token)] = int(rank)
        self.bytes = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.ending = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.ending.add_word(t.decode("latin-1"), (i, len(t)))
        self.ending.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.singles: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: the adjacent pair of least rank is merged until none is left. For short data only."""
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            ranks = [self.ids.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == 1 << 40:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether token b can stand right after token a in an encoding."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def stands(self, a: int) -> bool:
        """Whether token a is the encoding of its own bytes."""
        known = self.singles.get(a)
        if known is None:
            known = self.singles[a] = self.merged(self.bytes[a]) == [a]
        return known


class PrefixTable:
    """The last tokens of all prefixes of one piece (text between two splits)."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _ends(self, data: bytes, start: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(prefix length, tokens that end there, longest first) for all prefixes longer than start."""
        base = max(0, start - self.v.longest)
        at, found = -1, []
        for end, tok in self.v.ending.iter(data[base:].decode("latin-1")):
            end += base + 1
            if end <= start:
                continue
            if end != at:
                if found:
                    yield at, found
                at, found = end, []
            found.append(tok)
        if found:
            yield at, found

    def _last(self, last: list[int], end: int, tokens: list[tuple[int, int]]) -> int:
        for tok, length in tokens:
            begin = end - length
            if begin == 0:
                if self.v.stands(tok):
                    return tok
            elif begin > 0 and last[begin] >= 0 and self.v.follows(last[begin], tok):
                return tok
        raise ValueError("the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        """Text at the end; what is there stays as it is."""
        start, self.data = len(self.data), self.data + more
        for end, tokens in self._ends(self.data, start):
            self.last.append(self._last(self.last, end, tokens))

    def replace(self, begin: int, end: int, new: bytes) -> int:
        """new in place of bytes begin to end; gives the number of prefixes that had to be computed again."""
        data = self.data[:begin] + new + self.data[end:]
        old, shift = self.last, len(new) - (end - begin)
        last, same, done = old[: begin + 1], 0, 0
        for at, tokens in self._ends(data, begin):
            last.append(self._last(last, at, tokens))
            done += 1
            if at >= begin + len(new):
                # a prefix depends on the prefixes at most one longest token before it
                same = same + 1 if last[at] == old[at - shift] and at - shift > end else 0
                if same >= self.v.longest:
                    last += old[at - shift + 1 :]
                    break
        self.data, self.last = data, last
        return done

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.v.bytes[self.last[at]])
        return out[::-1]


class Encoder(dict):
    """Piece of text -> its ids; remembers short pieces, as most pieces are words seen before."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        super().__init__()
        self.v, self.split = vocabulary, regex.compile(pattern).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.v.ids.get(data)
        ids = (whole,) if whole is not None and self.v.stands(whole) else tuple(PrefixTable(self.v, data).ids())
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(rank_file: bytes, pattern: str = PATTERN) -> Encoder:
    """One encoder for each vocabulary and process."""
    key = (len(rank_file), hash(rank_file), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Vocabulary(rank_file), pattern)
    return _ENCODERS[key]


def encode(df: DataFrame, key: str, text: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", out: str = "ids", pattern: str = PATTERN) -> DataFrame:
    """Rows (key, out): the ids of each text as an array of integers, without special tokens, the text taken as it stands.

    Null and empty texts give an empty array; every row gives one, repeated rows and null keys too; a text of any length is one row.
    The rank file is read on the driver (about a megabyte) and sent to the tasks, which then need no file. No shuffle.
    """
    with open(vocabulary, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        split, get = enc.split, enc.__getitem__
        for b in batches:
            ends, ids, part = [0], [], []
            total = 0
            for t in b.column(1):
                t = t.as_py()
                if t:
                    got = list(chain.from_iterable(map(get, split(t))))
                    total += len(got)
                    part += got
                    if len(part) > 1_000_000:
                        ids.append(np.array(part, np.int32))
                        part = []
                ends.append(total)
            ids.append(np.array(part, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))], names=[key, out])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(out, T.ArrayType(T.IntegerType()))])
    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)

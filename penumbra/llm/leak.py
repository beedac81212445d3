"""Passages of held-out items inside a large corpus: a prefix-filtered set join over word shingles, verified exactly.

Words are read as a reader would read them: letter case, punctuation, marks, layout, invisible characters, entities and text decoded with
the wrong charset make no difference, and a word with lost characters stands for the item word that it fits. The items'
shingles are ordered by how rare they are in the corpus; of each item-sized window only the rarest shingles are looked up in the corpus, so many
that any passage that counts must share one of them. What shares one is held to the count and position bounds of its
window, and what remains is aligned word by word with the item, exactly.

Items are taken in blocks of bounded size, and only a block's shingles go to the tasks. The corpus is read once for each block and never
shuffled: the pass that counts shingles also writes out, as numbers of item words, those texts that share enough shingles with items at all,
and only these are searched when the counts are known.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penumbra.session import materialize

SHINGLE = 5
MIN_WORDS = 28  # least words of an item that a passage must hold
EDIT_SHARE = 10  # one word in so many may be changed, dropped or put in
SHARED = 8  # shingles that some window of MIN_WORDS must share: an edit breaks at most SHINGLE of them
DRIFT = 6  # edits of a passage of less than 2 * MIN_WORDS words, the most that its diagonal moves, and one
BLOCK_WORDS = 2_000_000  # item words of one block, the bound of what is sent to the tasks

_INVISIBLE = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff\u0483-\u0489]+")
_HIGH = re.compile("[\u0080-\u00ff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013\u2014\u2018-\u201a\u201c-\u201e\u2020-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122]{2,}")
_ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}|#\d{2,6}|#[xX][0-9A-Fa-f]{2,5});?")
_INNER = re.compile("(?<=\\w)(?:['\u2018\u2019\u02bc\u2032`\u00b4]|[-\u2010\u2011\u2043](?:[ \t]*\r?\n[ \t]*)?)(?=\\w)")
_WORD = re.compile("[\\w\ufffd]+")
_LETTERS = str.maketrans({"œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ı": "i"})


def _byte(c: str) -> bytes:
    try:
        return c.encode("cp1252")
    except UnicodeEncodeError:
        return c.encode("latin-1")


def _redecode(m: re.Match) -> str:
    """UTF-8 that was read as a single-byte charset, read again; anything else as it was."""
    s = m[0]
    try:
        raw = b"".join(map(_byte, s))
    except UnicodeEncodeError:
        return s
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        if s[0] in "ÃÂâ":
            return raw.decode("utf-8", "replace")
        return s


def words(text: str) -> list[str]:
    """The words of a text in a form that does not depend on how they are written, set or encoded."""
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(text)
        if "&" in text and _ENTITY.search(text):
            text = html.unescape(text)
    if not text.isascii():
        if "Ã" in text or "Â" in text or "â" in text:
            text = _HIGH.sub(_redecode, text)
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text)).casefold().translate(_LETTERS) if not text.isascii() else text.lower()
    else:
        text = text.lower()
    return _WORD.findall(_INNER.sub("", text))


class Block:
    """Items of one block: their words, their shingles, and which of them are looked up."""

    MULT = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, items: list[tuple]):
        self.keys = [k for k, _ in items]
        ws = [words(t) for _, t in items]
        self.ids: dict[str, int] = {}
        self.items = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in x], np.int64) for x in ws]
        self.fits: dict[str, int] = {}
        self.sorted = sorted(self.ids)
        self.turned = sorted(w[::-1] for w in self.ids)
        codes = [self.codes(x)[0] for x in self.items]
        code = np.concatenate([np.zeros(0, np.uint64), *codes])
        self.code, of = np.unique(code, return_inverse=True)
        of = of.astype(np.int32)
        order = np.argsort(of, kind="stable")
        n = np.array([len(c) for c in codes], np.int64)
        self.row_item = np.repeat(np.arange(len(codes), dtype=np.int32), n)[order]  # items that hold a shingle, by shingle
        self.row_start = np.searchsorted(of[order], np.arange(len(self.code) + 1))
        self.shingles = np.split(of, np.cumsum(n)[:-1]) if len(codes) else []  # shingles of an item by position
        self.prefix = np.ones(len(self.code), bool)

    def codes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the shingles of word ids, and where they hold known words only."""
        n = len(ids) - SHINGLE + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        u, c, known = ids.astype(np.uint64), np.zeros(n, np.uint64), np.ones(n, bool)
        with np.errstate(over="ignore"):
            for k in range(SHINGLE):
                c = (c + u[k : k + n]) * self.MULT
                c ^= c >> np.uint64(29)
                known &= ids[k : k + n] > 0
        return c, known

    def read(self, text: str) -> np.ndarray:
        """Item word ids of a text's words; 0 for words of no item."""
        get = self.ids.get
        ws = words(text)
        out = [get(w, 0) for w in ws]
        if "\ufffd" in text or "Ã" in text or "â" in text:
            for k, w in enumerate(ws):
                if not out[k] and "\ufffd" in w:
                    out[k] = self.fit(w)
        return np.array(out, np.int64)

    def fit(self, damaged: str) -> int:
        """The item word that a word with lost characters fits best: each lost character is none to three others.

        Only words that begin, or else end, with what is left at that end are looked at.
        """
        if damaged not in self.fits:
            if len(self.fits) > 100_000:
                self.fits.clear()
            found = self.ids.get(damaged.strip("\ufffd"), 0)
            if not found and len(damaged.replace("\ufffd", "")) >= 2:
                p = re.compile("".join(r"\w{0,3}" if c == "\ufffd" else re.escape(c) for c in damaged) + r"\Z")
                head, tail = damaged.split("\ufffd", 1)[0], damaged.rsplit("\ufffd", 1)[1]
                some = _starting(self.sorted, head) if len(head) >= len(tail) else [w[::-1] for w in _starting(self.turned, tail[::-1])]
                near = [w for w in some if abs(len(w) - len(damaged)) <= 2 + 2 * damaged.count("\ufffd") and p.match(w)]
                found = self.ids[min(near, key=lambda w: (abs(len(w) - len(damaged)), w))] if near else 0
            self.fits[damaged] = found
        return self.fits[damaged]

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shingle number, position in the text) of all shingles of the text that items have."""
        c, known = self.codes(ids)
        at = np.flatnonzero(known)
        if not len(at) or not len(self.code):
            return np.zeros(0, np.int64), at[:0]
        k = np.minimum(np.searchsorted(self.code, c[at]), len(self.code) - 1)
        same = self.code[k] == c[at]
        return k[same], at[same]

    def order_by_rarity(self, df: np.ndarray) -> None:
        """Keeps for looking up, of each window, its rarest shingles: all but SHARED - 1 of them.

        Rare are those that few pairs of a text and an item share.
        """
        self.prefix[:] = False
        pairs = df * np.diff(self.row_start)
        span = MIN_WORDS - SHINGLE + 1
        for sh in self.shingles:
            if len(sh) < span:
                continue
            rank = np.empty(len(sh), np.int64)
            rank[np.lexsort((sh, pairs[sh]))] = np.arange(len(sh))
            w = np.lib.stride_tricks.sliding_window_view(rank, span)
            least = np.sort(w, axis=1)[:, span - SHARED]  # the rarest span - SHARED + 1 of each window
            best = np.zeros(len(sh), bool)
            for k in range(span):
                best[k : k + len(w)] |= w[:, k] <= least
            self.prefix[sh[best]] = True

    def found(self, ids: np.ndarray) -> list[int]:
        """Items of which a text (as item word ids) holds a passage. Only rare shingles lead to items."""
        sh, at = self.hits(ids)
        if len(sh) < SHARED:
            return []
        rare = np.unique(sh[self.prefix[sh]])
        if not len(rare):
            return []
        some = np.unique(np.concatenate([self.row_item[self.row_start[r] : self.row_start[r + 1]] for r in rare]))
        return [int(i) for i in some if len(self.items[i]) >= MIN_WORDS and self._holds(int(i), ids, sh, at)]

    def _holds(self, i: int, ids: np.ndarray, sh: np.ndarray, at: np.ndarray) -> bool:
        """Whether a text holds a passage of item i: near SHARED distinct shingles of one item window on about one diagonal, an exact alignment.

        Passages of 2 * MIN_WORDS words or more hold shorter ones, so that an alignment needs no more than the words around, however
        long text and item are.
        """
        own = self.shingles[i]
        order = np.argsort(own, kind="stable")
        lo, hi = np.searchsorted(own[order], sh), np.searchsorted(own[order], sh, "right")
        n = hi - lo
        if (n > 0).sum() < SHARED:
            return False
        pos = order[np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
        doc = np.repeat(at, n)
        order = np.lexsort((pos, doc))
        p, d, item, wide = pos[order], doc[order], self.items[i], 2 * MIN_WORDS + DRIFT
        reach = MIN_WORDS + MIN_WORDS // EDIT_SHARE + 4
        end = np.searchsorted(d, d + reach)
        done: list[tuple[int, int]] = []  # (place, diagonal) of what was aligned
        for a in np.flatnonzero(end - np.arange(len(d)) >= SHARED):
            diag = p[a : end[a]] - d[a : end[a]]
            while done and done[0][0] + wide <= d[a]:
                done.pop(0)
            if any(abs(diag[0] - y) <= DRIFT for _, y in done):
                continue
            if len(np.unique(p[a : end[a]][np.abs(diag - diag[0]) <= DRIFT])) < SHARED:
                continue
            # whatever passage holds this shingle, or one of the next `wide` on this diagonal, lies in here
            words_ = item[max(0, p[a] - wide - DRIFT) : p[a] + 2 * wide + DRIFT]
            if best_passage(words_, ids[max(0, d[a] - wide) : d[a] + 2 * wide + SHINGLE]):
                return True
            done.append((int(d[a]), int(diag[0])))
        return False


def _starting(words_: list[str], head: str) -> list[str]:
    """The words of a sorted list that begin with `head`."""
    return words_[bisect.bisect_left(words_, head) : bisect.bisect_right(words_, head + "\U0010ffff")]


def best_passage(item: np.ndarray, text: np.ndarray) -> tuple[int, int] | None:
    """(item words, edits) of a stretch of at least MIN_WORDS item words with at most one edit in EDIT_SHARE of them; None if the text holds none.

    Edits count wherever they are, at the ends too. Exact: for each number of edits, the longest stretch that ends at a pair of places. A stretch of twice MIN_WORDS or more is cut in two of
    which one holds as well, so that more edits than those of 2 * MIN_WORDS - 1 words need not be looked at.
    """
    most = (2 * MIN_WORDS - 1) // EDIT_SHARE
    need = np.maximum(MIN_WORDS, EDIT_SHARE * np.arange(most + 1))[:, None]
    last = np.zeros((most + 1, len(text) + 1), np.int16)  # by edits and text place: item words of the longest stretch
    for w in item:
        row = np.zeros_like(last)
        row[:, 1:] = np.where(text == w, last[:, :-1] + 1, 0)
        np.maximum(row[1:], last[:-1] + 1, out=row[1:])  # dropped
        np.maximum(row[1:, 1:], last[:-1, :-1] + 1, out=row[1:, 1:])  # changed
        for e in range(1, most + 1):
            np.maximum(row[e, 1:], row[e - 1, :-1], out=row[e, 1:])  # put in
        if (row >= need).any():
            e = int(np.argmax((row >= need).any(axis=1)))
            return int(row[e].max()), e
        last = row
    return None


def find_leaks(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """Rows (doc_key, item_key): the text holds a stretch of at least 28 words of the item, at most one in ten of them edited.

    An edited word counts wherever it stands, also first or last: 26 unchanged words inside an item are a stretch of 28 with two dropped.
    Null and empty texts hold nothing, items of fewer words are never held. Repeated documents give repeated rows, repeated items one.
    An empty table gives an empty one. A text of any length is read whole. If the two keys have one name, the item's gets the suffix _item.
    """
    src = docs.select(F.col(doc_key).alias("_k"), F.col(text).alias("_t")).where(F.col("_t").isNotNull())
    item_name = item_key if item_key != doc_key else f"{item_key}_item"
    schema = T.StructType([T.StructField(doc_key, docs.schema[doc_key].dataType), T.StructField(item_name, items.schema[item_key].dataType)])
    out: list[DataFrame] = []
    read_schema = T.StructType([T.StructField("_k", docs.schema[doc_key].dataType), *T._parse_datatype_string("_ids binary, shingle bigint, n bigint").fields])
    for rows in _blocks(items, item_key, item_text):
        block = Block(rows)
        once = materialize(src.mapInPandas(_read(block), read_schema), "leak")
        counts = once.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
        df = np.zeros(len(block.code), np.int64)
        df[counts["shingle"].to_numpy()] = counts["n"].to_numpy()
        block.order_by_rarity(df)
        out.append(once.where("_ids is not null").select("_k", "_ids").mapInPandas(_search(block, [doc_key, item_name]), schema))
    return reduce(DataFrame.unionByName, out) if out else docs.sparkSession.createDataFrame([], schema)


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """Items in blocks of at most BLOCK_WORDS words or one item; read one by one, so that the driver holds one block."""
    block, size = [], 0
    one = items.where(F.col(text).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias("_t")).orderBy(key)
    for r in one.toLocalIterator():
        n = len(r[1]) // 4
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def _read(block: Block):
    """Counts of a task's shingles, and the texts (as item word ids) that share enough of them with items to hold a passage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(block.code), np.int64)
        for b in batches:
            keys, texts = [], []
            for k, t in zip(b["_k"], b["_t"]):
                ids = block.read(t)
                sh = np.unique(block.hits(ids)[0])
                n[sh] += 1
                if len(sh) >= SHARED:
                    keys.append(k)
                    texts.append(ids.astype(np.int32).tobytes())
            if keys:
                yield pd.DataFrame({"_k": keys, "_ids": texts, "shingle": None, "n": None}, dtype=object)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"_k": None, "_ids": None, "shingle": at, "n": n[at]}, dtype=object)

    return run


def _search(block: Block, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, block.keys[i]) for k, t in zip(b["_k"], b["_ids"]) for i in block.found(np.frombuffer(t, np.int32).astype(np.int64))]
            yield pd.DataFrame(rows, columns=names)

    return run

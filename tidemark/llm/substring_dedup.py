"""Exact repeated passages: winnowed anchors, extended to windows and maximal repeats.

Seed.  Every ``anchor_words`` consecutive words have a hash; winnowing keeps
the smallest of each ``window - anchor_words + 1`` neighbours, so every window
holds at least one anchor, the same one wherever the window's words occur.  An
anchor whose hash occurs once cannot lie in a repeated window.

Extend.  Around the anchors that do repeat, the windows whose anchor is not
unique are extended left and right over the words and compared by their hash.
Overlapping repeated windows form the maximal repeats.

Both steps ask which hashes occur *once*: a grouped minimum and count, combined
before the shuffle, of which only the unique occurrences go back to their
document.  A passage in a third of all documents therefore costs one row per
task, and no pair of documents is ever formed.

Hashes have 64 bits: among N windows a unique one is taken for a repeat with
probability N / 2**64.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import stored

WINDOW_WORDS = 35
ANCHOR_WORDS = 16
#: Rows of one output flush; bytes of text and of words that are held as arrays at once; longest word hashed byte by byte.
FLUSH, SLICE_BYTES, BLOCK_BYTES, LONG_WORD = 400_000, 4_000_000, 4_000_000, 256
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2 ** 64)
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Slice:
    """The words of some consecutive texts: bytes, word starts and ends, the text of each
    word, the first word of each text (and the end), and 64-bit hashes of the words."""
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> "Slice":
        """``offsets``: where each text begins in ``data``, and the end."""
        word = np.zeros(len(data) + 1, bool)
        word[:-1] = ~_SPACE[data]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1                     # where words begin or stop
        inside = offsets[(offsets > 0) & (offsets < len(data))]
        touch = np.unique(inside[word[inside] & word[inside - 1]])           # a text ends and the next begins with a word
        edge = np.sort(np.concatenate([[0] * bool(word[0]), edge, touch, touch])).astype(np.int64)
        starts, ends = edge[::2], edge[1::2]
        doc = np.searchsorted(offsets, starts, "right") - 1
        return cls(data, starts, ends, doc, np.searchsorted(doc, np.arange(len(offsets))))

    def hashes(self) -> np.ndarray:
        """From bytes times powers, block by block; long words by a digest."""
        out = np.zeros(len(self.starts), np.uint64)
        size = self.ends - self.starts
        power = _powers(_ODD, LONG_WORD)
        cut = np.concatenate([[0], np.cumsum(np.minimum(size, LONG_WORD))])
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(cut, cut[i] + BLOCK_BYTES, "right")) - 1)
            n = np.minimum(size[i:j], LONG_WORD)
            begin = np.cumsum(n) - n
            at = np.arange(int(n.sum())) - np.repeat(begin, n)               # place inside the word
            value = (self.data[at + np.repeat(self.starts[i:j], n)].astype(np.uint64) + np.uint64(1)) * power[at]
            out[i:j] = _mixed(np.add.reduceat(value, begin) + n.astype(np.uint64) * np.uint64(_INVERSE))
            i = j
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            word = self.data[self.starts[i]:self.ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out

    def whole(self, k: int) -> np.ndarray:
        """True where k consecutive words lie in one text."""
        return self.doc[k - 1:] == self.doc[:len(self.doc) - k + 1] if len(self.doc) >= k else np.zeros(0, bool)

    def places(self, lists: list, n: int) -> np.ndarray:
        """Marks over ``n`` words: the positions listed for each text, null for none."""
        out = np.zeros(n, bool)
        for first, at in zip(self.first.tolist(), lists):
            if at is not None and len(at):
                out[np.asarray(at, np.int64) + first] = True
        return out

    def kept(self, keep: np.ndarray) -> pa.Array:
        """Per text the marked words, joined by one space, as binary."""
        n = (self.ends - self.starts + 1)[keep]                              # a word and the space after it
        begin = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(begin, n) + np.repeat(self.starts[keep], n)
        out = np.append(self.data, np.uint8(32))[at]
        out[begin + n - 1] = 32
        doc = self.doc[keep]
        last = np.ones(len(doc), bool)
        last[:-1] = doc[1:] != doc[:-1]                                      # no space after a text's last word
        drop = np.ones(len(out), bool)
        drop[(begin + n - 1)[last]] = False
        size = np.bincount(doc, n - last, minlength=len(self.first) - 1).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)),
                                                                   pa.py_buffer(out[drop])]).cast(pa.binary())


def _slices(batches) -> Iterator[tuple[pa.RecordBatch, Slice]]:
    """Rows whose last column holds texts, cut where they exceed SLICE_BYTES, and their words."""
    for b in batches:
        text = b.column(b.num_columns - 1)
        size = np.nan_to_num(pa.compute.binary_length(text).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(total, total[i] + SLICE_BYTES, "right")) - 1)
            data = np.frombuffer(b"".join(x for x in text.slice(i, j - i).to_pylist() if x), np.uint8)
            yield b.slice(i, j - i), Slice.of(data, total[i:j + 1] - total[i])
            i = j


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def runs_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, from one prefix sum of ``hash * odd ** i``."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_ODD, len(words)))])
    return _mixed((prefix[k:] - prefix[:-k]) * _powers(_INVERSE, n))


def _sliding(x: np.ndarray, k: int, pick) -> np.ndarray:
    """``pick`` (minimum, maximum) over every k neighbours, by doubling."""
    width = 1
    while 2 * width <= k:
        x, width = pick(x[:-width], x[width:]), 2 * width
    return pick(x[: len(x) - (k - width)], x[k - width:]) if width < k else x


def anchors(h: np.ndarray, whole: np.ndarray, span: int) -> np.ndarray:
    """Positions that hold the minimum of the ``span`` neighbours of some window (all of equal minima);
    ``whole``: the windows that count."""
    if not len(whole):
        return np.zeros(0, np.int64)
    low = np.where(whole, _sliding(h, span, np.minimum), np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    return np.flatnonzero((_sliding(np.concatenate([pad, low, pad]), span, np.maximum) == h) & (h > 0))


def candidates(h: np.ndarray, whole: np.ndarray, unique: np.ndarray, span: int) -> np.ndarray:
    """Starts of the windows whose own anchor (the minimum of h over ``span``) is not marked ``unique``."""
    if not len(whole):
        return np.zeros(0, np.int64)
    alone = np.where(unique[:len(h)], h, np.uint64(2 ** 64 - 1))
    return np.flatnonzero(whole & (_sliding(alone, span, np.minimum) != _sliding(h, span, np.minimum)))


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """True for words inside a window that begins at one of ``starts``."""
    steps = np.zeros(n_words + 1, np.int64)
    if len(starts):
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + window, -1)
    return np.cumsum(steps[:n_words]) > 0


def repeats(cover: np.ndarray, first: np.ndarray) -> pa.Array:
    """Per text the maximal covered stretches as structs (first word, word after the last)."""
    start = np.zeros(len(cover) + 1, bool)
    start[first[first < len(cover)]] = True                                  # a stretch ends with its text
    on = np.concatenate([cover, [False]])
    was = np.concatenate([[False], cover])
    begin = np.flatnonzero(on & (~was | start))
    after = np.flatnonzero(was & (~on | start))
    doc = np.searchsorted(first, begin, "right") - 1
    base = first[doc]
    edges = np.searchsorted(doc, np.arange(len(first)))
    spans = pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((after - base).astype(np.int32))], names=["first", "after"])
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), spans)


def _found(rows: np.ndarray, piece: Slice, h: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches (hash, row, position in the text) of the words at ``at``."""
    doc = piece.doc[at]
    pos = at - piece.first[doc]
    for i in range(0, len(at), FLUSH):
        part = slice(i, i + FLUSH)
        yield pa.RecordBatch.from_arrays([pa.array(h[at[part]].view(np.int64)), pa.array(rows[doc[part]]), pa.array(pos[part].astype(np.int32))],
                                         names=["hash", "row", "pos"])


def _once(found: DataFrame, name: str) -> DataFrame:
    """(row, positions) of the hashes that occur once in all rows."""
    single = (found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.min("pos").alias("pos"))
              .where("n = 1"))
    return stored(single.groupBy("row").agg(F.collect_list("pos").alias(name)))


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS,
                   anchor: int = ANCHOR_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``id, n_words, repeats array<struct<first, after>>,
    kept`` (the words outside, joined by one space).

    Null and empty texts have no words.  Ids may be null or repeated: rows are
    told apart by a hash of id and text, and rows equal in both repeat each
    other's windows, as any copies do.  Only the two columns are read.  A text is held
    whole in its task, some 40 bytes a word beside it.
    """
    if not 0 < anchor <= window:
        raise ValueError("the anchor must fit into the window")
    texts = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).cast("long").alias("id"),
                        F.col(text_col).cast("binary").alias("text"))
    span = window - anchor + 1

    def seed(batches):
        for b, piece in _slices(batches):
            h = runs_hash(piece.hashes(), anchor)
            yield from _found(b.column(0).to_numpy(), piece, h, anchors(h, piece.whole(window), span))

    def extend(batches):
        for b, piece in _slices(batches):
            words = piece.hashes()
            unique = piece.places(b.column(1).to_pylist(), len(words))
            at = candidates(runs_hash(words, anchor), piece.whole(window), unique, span)
            yield from _found(b.column(0).to_numpy(), piece, runs_hash(words, window), at)

    def cut(batches):
        for b, piece in _slices(batches):
            n = len(piece.starts)
            words, hit = piece.hashes(), np.zeros(n, bool)
            unique = piece.places(b.column(1).to_pylist(), n)
            hit[candidates(runs_hash(words, anchor), piece.whole(window), unique, span)] = True
            hit &= ~piece.places(b.column(2).to_pylist(), n)
            cover = covered(n, np.flatnonzero(hit), window)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(piece.first)), repeats(cover, piece.first), piece.kept(~cover)],
                names=["id", "n_words", "repeats", "kept"])

    lone = _once(texts.select("row", "text").mapInArrow(seed, "hash long, row long, pos int"), "unique")
    around = texts.join(lone, "row", "left").select("row", "unique", "text")
    single = _once(around.mapInArrow(extend, "hash long, row long, pos int"), "once")
    both = texts.join(lone.join(single, "row", "full"), "row", "left").select("id", "unique", "once", "text")
    return (both.mapInArrow(cut, "id long, n_words long, repeats array<struct<first:int,after:int>>, kept binary")
            .withColumn("kept", F.col("kept").cast("string")))

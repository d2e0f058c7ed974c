"""SentencePiece-style unigram encoding and decoding.

A text is normalised as the model file asks (a leading marker, blanks become
markers) and cut into the pieces whose log scores sum highest: Viterbi over a
double-array trie of the pieces.  A character that no piece covers falls back
to one token per UTF-8 byte.  Decoding joins the pieces' bytes, turns markers
into blanks and drops the leading one.

No piece holds a marker after another character, so the best cut of a text is
the best cut of its words (markers and what follows up to the next marker),
each by itself.  Words are cut once and remembered in a bounded table; new
words of a block of texts go through the trie together, as arrays.
"""
from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
_MARK = MARKER.encode()
#: Fixed values of the model file's format: kinds of piece, unknown penalty.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Words a worker remembers, bytes of text and of new words handled at a time.
REMEMBERED, BLOCK, SLAB = 200_000, 2_000_000, 100_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    def varint(i):
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i
    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = data[i:i + n], i + n
        yield key >> 3, value


class DoubleArray:
    """Trie over bytes: from state s byte c leads to ``base[s] + c`` if
    ``check`` there is s.  ``value`` is the key's index, or -1."""

    def __init__(self, keys: list[bytes], values: list[int]):
        tree: dict = {}
        for key, value in zip(keys, values):
            node = tree
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        # single children fill the first holes, families look for room near the front
        check[0], low, front, todo = 0, 257, 257, [(0, tree)]
        for state, node in todo:                                   # breadth first; grows while it runs
            value[state] = node.get(-1, -1)
            codes = sorted(c for c in node if c >= 0)
            if not codes:
                continue
            while check[low] >= 0:
                low += 1
            at = low - codes[0] if len(codes) == 1 else front
            while True:
                if at + 256 >= len(check):
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                if all(check[at + c] < 0 for c in codes):
                    break
                at += 1
            base[state] = at
            if len(codes) > 1 and at > front + 64:
                front = at - 32
            for c in codes:
                check[at + c] = state
                todo.append((at + c, node[c]))
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))


@dataclass
class Vocabulary:
    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    trie: DoubleArray
    unknown_score: float
    prefix: bool
    words: dict[bytes, bytes] = field(default_factory=dict)
    older: dict[bytes, bytes] = field(default_factory=dict)

    @classmethod
    def parse(cls, data: bytes) -> "Vocabulary":
        """Read a serialised model; what is not supported raises ValueError."""
        found, prefix, squeeze, charsmap = [], True, True, b""
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                found.append((f.get(1, b""), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 3:
                f = dict(_fields(value))
                charsmap, prefix, squeeze = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
        byte_ids = np.full(256, -1, np.int32)
        for i, (piece, _, kind) in enumerate(found):
            if kind == BYTE:
                byte_ids[int(piece[3:5], 16)] = i
        normal = [i for i, (_, _, kind) in enumerate(found) if kind == NORMAL]
        if charsmap or squeeze or any(kind == USER for _, _, kind in found) or (byte_ids < 0).any():
            raise ValueError("only models with identity normalisation, kept blanks and byte fallback are supported")
        if any(re.search(rf"[^{MARKER}]{MARKER}", found[i][0].decode()) for i in normal):
            raise ValueError("a piece holds a marker after another character")
        scores = np.array([s for _, s, _ in found])
        plain = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(_MARK, b" ") if kind == NORMAL else b""
                 for p, _, kind in found]
        return cls(plain, scores, byte_ids, DoubleArray([found[i][0] for i in normal], normal),
                   scores[normal].min() - UNKNOWN_PENALTY, prefix)

    def cut(self, words: list[bytes]) -> list[bytes]:
        """Token ids (int32 bytes) of every word: one Viterbi over all words at
        once, by start offset.  Of equal sums the longest last piece wins."""
        text = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        starts = np.concatenate([[0], ends[:-1]])
        of = np.repeat(np.arange(len(words)), ends - starts)
        stop = ends[of]
        first = np.flatnonzero((text & 0xC0) != 0x80)
        width = np.diff(np.append(first, len(text)))
        # every piece that starts at every character
        at, state, src, dst, ids = first, np.zeros(len(first), np.int64), [], [], []
        single, which, depth = np.zeros(len(text), bool), np.arange(len(first)), 0
        while len(at):
            here = at + depth < stop[at]
            at, state, which = at[here], state[here], which[here]
            to = self.trie.base[state] + text[at + depth]
            ok = self.trie.check[to] == state
            at, state, which = at[ok], to[ok], which[ok]
            depth += 1
            value = self.trie.value[state]
            hit = value >= 0
            src.append(at[hit]), dst.append(at[hit] + depth), ids.append(value[hit])
            single[at[hit & (width[which] == depth)]] = True
        lone = ~single[first]
        src.append(first[lone]), dst.append((first + width)[lone]), ids.append(np.full(lone.sum(), -1))
        src, dst, ids = np.concatenate(src), np.concatenate(dst), np.concatenate(ids)
        gain = np.where(ids >= 0, self.scores[ids], self.unknown_score)
        offset = src - starts[of[src]]
        order = np.argsort(offset, kind="stable")
        src, dst, ids, gain = src[order], dst[order], ids[order], gain[order]
        steps = np.searchsorted(offset[order], np.arange(int(offset.max(initial=0)) + 2))
        # best[p]: best sum of a cut that ends before byte p of the words; word starts share no cell with ends
        best, back, last = np.full(len(text) + 1, -np.inf), np.zeros(len(text) + 1, np.int64), np.zeros(len(text) + 1, np.int64)
        for lo, hi in zip(steps[:-1].tolist(), steps[1:].tolist()):
            s, d = src[lo:hi], dst[lo:hi]
            total = gain[lo:hi] if lo == 0 else gain[lo:hi] + best[s]
            up = total > best[d]
            d = d[up]
            best[d], back[d], last[d] = total[up], s[up], ids[lo:hi][up]
        token, used = np.zeros(len(text) + 1, np.int32), np.zeros(len(text) + 1, bool)
        word, cur = np.arange(len(words)), ends
        while len(cur):
            used[cur], token[cur] = True, last[cur]
            for k in range(4):                                        # byte fallback of a lone character
                p = cur[(last[cur] < 0) & (back[cur] + k < cur)]
                p = back[p] + k
                used[p + 1], token[p + 1] = True, self.byte_ids[text[p]]
            cur = back[cur]
            more = cur > starts[word]
            word, cur = word[more], cur[more]
        spots = np.flatnonzero(used)
        flat = token[spots].tobytes()
        upto = (np.searchsorted(spots, ends, side="right") * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *upto[:-1]], upto)]

    def _learn(self, fresh: set[bytes]) -> None:
        slab, size = [], 0
        for word in sorted(fresh, key=len):
            slab.append(word)
            size += len(word) + 3
            if size >= SLAB:
                self.words.update(zip(slab, self.cut([_MARK + w for w in slab])))
                slab, size = [], 0
        if slab:
            self.words.update(zip(slab, self.cut([_MARK + w for w in slab])))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids (int32 bytes) of every UTF-8 text."""
        split = [_words(t, self.prefix) for t in texts]
        if len(self.words) > REMEMBERED:              # words seen since the last time survive
            self.words, self.older = {}, self.words
        known, older = self.words, self.older
        fresh = set().union(*split).difference(known)
        seen = fresh.intersection(older)
        known.update((w, older[w]) for w in seen)
        fresh -= seen
        self._learn(fresh)
        return [b"".join(map(known.__getitem__, ws)) for ws in split]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD, control ids nothing."""
        out = b"".join(map(self.pieces.__getitem__, ids))
        if self.prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


_RUNS = re.compile(rf"{MARKER}+[^{MARKER}]*")


def _words(text: bytes, prefix: bool) -> list[bytes]:
    """Words of a text without their first marker."""
    if not text:
        return []
    words = text.split(b" ")
    if prefix and b"" not in words and _MARK not in text:
        return words
    marked = (MARKER if prefix else "") + text.decode().replace(" ", MARKER)
    if not marked.startswith(MARKER):
        raise ValueError("models without a leading marker are not supported")
    return [w[1:].encode() for w in _RUNS.findall(marked)]


def load(spark: SparkSession, path: str = MODEL_PATH):
    """Broadcast vocabulary of a model file that the driver can read (a few MB, fixed by the file)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(Vocabulary.parse(f.read()))


def encode(docs: DataFrame, vocabulary, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` plus ``ids array<int>``: empty for an empty text, null for a null one."""
    @F.arrow_udf("array<int>")
    def run(text: pa.Array) -> pa.Array:
        v, out, block, size = vocabulary.value, [], [], 0
        for t in text:
            t = t.as_py()
            block.append(t or b"")
            size += len(t or b"")
            if size >= BLOCK:
                out += v.encode(block)
                block, size = [], 0
        out += v.encode(block)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, out), np.int64, len(out)) // 4)])
        values = pa.array(np.frombuffer(b"".join(out), np.int32))
        mask = pa.array(text.is_null().to_numpy(zero_copy_only=False)) if text.null_count else None
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, mask=mask)

    return docs.withColumn(ids_col, run(F.col(text_col).cast("binary")))


def decode(tokens: DataFrame, vocabulary, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` plus the text of their ids; null ids give null.  A text without
    literal markers comes back exactly (markers come back as blanks)."""
    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        v = vocabulary.value
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        out = []
        for null, a, b in zip(ids.is_null().to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
            out.append(None if null else v.decode(flat[a:b].tolist()))
        return pa.array(out, pa.string())

    return tokens.withColumn(text_col, run(F.col(ids_col)))

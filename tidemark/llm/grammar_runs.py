"""Periodic runs of words, found on a grammar of each text.

Grammar.  Re-Pair over the word ids: the most frequent pair of neighbouring
symbols becomes a new nonterminal until no pair occurs twice in its document.
Pairs that do not overlap are replaced in one round: an occurrence is taken when
its pair is more frequent than the pairs it overlaps.  Every occurrence of a
nonterminal is created in the text, so all its derivation positions are known.
The symbols that remain hang below a balanced tree, whose nodes occur once.

Runs.  The lowest node whose expansion holds a run whole is cut by the run at
its boundary m (the end of its left part).  So the runs that cross m are looked
for once per nonterminal, inside its first expansion.  A run of period q and length
>= max(24, 3q) reaches at least max(12, 1.5q) words to one side of m; the
``GRAM`` words on that side of m occur again q words away.  Those repeats give
the candidate periods (at most a third of the expansion), common extensions to
both sides give the run, and the smallest period of each stretch is kept.

The runs are moved to all derivation positions; of the intervals of one period
those inside another one go, the maximal ones stay.

Extensions compare prefix hashes (two primes of 31 bits) by bisection; each run
is compared word by word before it is returned.

Work is done on slabs of whole documents in arrays: O(w log w) for w words, the
same for a repeated word and for prose.  A text is never cut; one of w words
takes about 200 w bytes in its task.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MIN_WORDS, MIN_PERIODS = 24, 3
GRAM = 4
#: Words of a slab of documents; candidate periods compared at once.
SLAB_WORDS, CHUNK = 200_000, 1_000_000
#: Hash moduli and bases.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_103_515_245, 48_271)

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Extensions:
    """Common extensions of two positions of one symbol array."""

    def __init__(self, sym: np.ndarray):
        self.n, self.tables = len(sym), []
        for p, base in zip(PRIMES, BASES):
            power = np.ones(max(1, self.n), np.int64)
            done = 1
            while done < self.n:
                k = min(done, self.n - done)
                power[done:done + k] = power[:k] * (power[done - 1] * base % p) % p
                done += k
            value = (sym * 2_654_435_761 + 12_345) % p
            self.tables.append((p, power, np.concatenate([[0], np.cumsum(value * power[:self.n] % p)])))

    def same(self, x: np.ndarray, y: np.ndarray, k) -> np.ndarray:
        """True where the k symbols from x and from y > x are equal."""
        out = np.ones(len(x), bool)
        for p, power, prefix in self.tables:
            out &= (prefix[x + k] - prefix[x]) % p * power[y - x] % p == (prefix[y + k] - prefix[y]) % p
        return out

    def reach(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
        """Length of the common extension after (``back``: before) x and y, up to ``limit``."""
        got = np.zeros(len(x), np.int64)
        step = 1 << max(0, int(limit.max(initial=0)).bit_length() - 1)
        while step:
            at = np.flatnonzero(got + step <= limit)
            shift = -got[at] - step if back else got[at]
            got[at[self.same(x[at] + shift, y[at] + shift, step)]] += step
            step >>= 1
        return got


def repair(sym: np.ndarray, doc: np.ndarray):
    """Re-Pair of the symbols, pairs within one document only.

    Symbols of different documents must differ.  Returns the occurrences of the
    nonterminals as arrays (rule, start, left size, size) and the starts and
    sizes of the symbols that remain, by position.
    """
    sym, start, size = sym.copy(), np.arange(len(sym)), np.ones(len(sym), np.int64)
    top = int(sym.max(initial=-1)) + 1
    rules, rest = [], []
    while len(sym) > 1:
        many = np.bincount(sym, minlength=top) > 1
        same = sym[1:] == sym[:-1]
        at = np.arange(len(same))
        odd = same & ((at - np.maximum.accumulate(np.where(same, -1, at))) % 2 == 0)   # every second of a row of equal pairs
        at = at[many[sym[:-1]] & many[sym[1:]] & ~odd]
        _, pair, count = np.unique(sym[at] * top + sym[at + 1], return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(1, len(count) + 1)
        rank[count < 2] = 0
        weight = np.zeros(len(sym) + 1, np.int64)
        weight[at + 1] = rank[pair]
        own = weight[at + 1]
        taken = (own > 0) & (own > weight[at]) & (own > weight[at + 2 - (at + 2 > len(sym))])
        at, pair = at[taken], pair[taken]
        twice = np.bincount(pair, minlength=len(count)) > 1
        at, pair = at[twice[pair]], pair[twice[pair]]
        if not len(at):
            break
        rule = top + (np.cumsum(twice) - 1)[pair]
        top += int(twice.sum())
        rules.append((rule, start[at], size[at], size[at] + size[at + 1]))
        sym[at] = rule
        size[at] += size[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        open_ = np.zeros(int(doc.max()) + 1, bool)      # a document without a repeated pair is finished
        open_[doc[at]] = True
        done = keep & ~open_[doc]
        rest.append((start[done], size[done]))
        keep &= open_[doc]
        sym, start, size, doc = sym[keep], start[keep], size[keep], doc[keep]
    rest.append((start, size))
    tops = [np.concatenate(x) for x in zip(*rest)]
    order = np.argsort(tops[0], kind="stable")
    none = [np.zeros(0, np.int64)] * 4
    return ([np.concatenate(x) for x in zip(*rules)] if rules else none), [x[order] for x in tops]


def tree_nodes(start: np.ndarray, size: np.ndarray, edges: np.ndarray, least: int):
    """Nodes (lo, m, hi) of balanced trees over the symbols of each document."""
    end = start + size
    i, j = np.searchsorted(start, edges[:-1]), np.searchsorted(start, edges[1:])
    out = []
    while True:
        big = j - i > 1
        i, j = i[big], j[big]
        big = end[j - 1] - start[i] >= least
        i, j = i[big], j[big]
        if not len(i):
            break
        mid = (i + j) // 2
        out.append((start[i], start[mid], end[j - 1]))
        i, j = np.concatenate([i, mid]), np.concatenate([mid, j])
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


class Grams:
    """Positions of the ``GRAM`` words that occur more than once, by hash."""

    def __init__(self, sym: np.ndarray):
        n = max(0, len(sym) - GRAM + 1)
        h = np.zeros(n, np.uint64)
        for k in range(GRAM):
            h = (h ^ sym[k:k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        bits = max(10, int(n).bit_length() + 3)
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
        self.at = np.flatnonzero((np.bincount(bucket, minlength=1) > 1)[bucket])
        self.at = self.at[np.argsort(h[self.at], kind="stable")]
        group = np.cumsum(np.diff(h[self.at], prepend=h[self.at[:1]]) != 0) if len(self.at) else np.zeros(0, np.int64)
        self.wide = len(sym) + 1
        self.key = group * self.wide + self.at             # ordered by gram, then position
        self.place = np.full(len(sym) + 1, -1)
        self.place[self.at] = np.arange(len(self.at))

    def near(self, x: np.ndarray, most: np.ndarray, back: bool):
        """Ranges of entries whose gram equals that at x, up to ``most`` words after (before) it."""
        place = self.place[x]
        ok = (place >= 0) & (most > 0)
        key = np.where(ok, self.key[place] if len(self.key) else 0, 0)
        if back:
            first = np.searchsorted(self.key, key - np.minimum(most, x), "left")
            return np.where(ok, first, 0), np.where(ok, place, 0)
        return np.where(ok, place + 1, 0), np.where(ok, np.searchsorted(self.key, key + np.minimum(most, self.wide - 1 - x), "right"), 0)


def runs_at(lo: np.ndarray, m: np.ndarray, hi: np.ndarray, sym: np.ndarray, least: int, periods: int):
    """Runs (node, first, after, period) inside lo..hi that cross m, smallest periods only."""
    grams, ext = Grams(sym), None
    found = []
    most = (hi - lo) // periods
    for back in (False, True):
        x = m - GRAM if back else m
        room = np.minimum(most, x - lo if back else hi - GRAM - x)
        usable = np.flatnonzero((room > 0) & (x >= lo) & (x + GRAM <= hi))
        a, b = grams.near(x[usable], room[usable], back)
        total = np.concatenate([[0], np.cumsum(b - a)])
        cut = np.unique(np.searchsorted(total, np.arange(0, total[-1] + CHUNK, CHUNK)).clip(0, len(usable)))
        for i, j in zip(cut[:-1], np.append(cut[1:-1], len(usable))):
            n = b[i:j] - a[i:j]
            node = np.repeat(usable[i:j], n)
            if not len(node):
                continue
            entry = np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[i:j], n)
            q = np.abs(grams.at[entry] - np.repeat(x[usable[i:j]], n))
            ext = ext or Extensions(sym)
            left = np.repeat(m[usable[i:j]], n) - (q if back else 0)           # compare left.. with left + q..
            need = np.maximum((least + 1) // 2, (periods * q + 1) // 2) - q        # what the longer side must show
            base = m[node] - need - q if back else left
            fits = (base >= lo[node]) if back else (base + q + need <= hi[node])
            node, q, left, base, need = node[fits], q[fits], left[fits], base[fits], need[fits]
            good = ext.same(base, base + q, need)
            node, q, left = node[good], q[good], left[good]
            after = left + q + ext.reach(left, left + q, hi[node] - left - q)
            first = left - ext.reach(left, left + q, left - lo[node], back=True)
            good = after - first >= np.maximum(least, periods * q)
            found.append((node[good], first[good], after[good], q[good]))
    if not found:
        return [np.zeros(0, np.int64)] * 4
    node, first, after, q = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((q, after, first, node))
    node, first, after, q = node[order], first[order], after[order], q[order]
    new = np.ones(len(node), bool)
    new[1:] = (np.diff(node) != 0) | (np.diff(first) != 0) | (np.diff(after) != 0)
    return node[new], first[new], after[new], q[new]


def maximal(first: np.ndarray, after: np.ndarray, q: np.ndarray):
    """Intervals that no other of the same period contains, each once, by period and start."""
    order = np.lexsort((-after, first, q))
    first, after, q = first[order], after[order], q[order]
    group = np.cumsum(np.diff(q, prepend=q[:1]) != 0) * (int(after.max(initial=0)) + 1)
    high = np.maximum.accumulate(after + group)
    keep = np.ones(len(q), bool)
    keep[1:] = (after + group)[1:] > high[:-1]
    return first[keep], after[keep], q[keep]


def find_runs(sym: np.ndarray, edges: np.ndarray, least: int = MIN_WORDS, periods: int = MIN_PERIODS):
    """Runs (first, after, period) of the documents that lie between ``edges`` of one symbol array."""
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    width = int(sym.max(initial=0)) + 1
    sym = np.unique(doc * width + sym, return_inverse=True)[1].astype(np.int64)         # no symbol in two documents
    (rule, at, left, size), (start, length) = repair(sym, doc)
    big = size >= least
    rule, at, left, size = rule[big], at[big], left[big], size[big]
    order = np.lexsort((at, rule))
    rule, at, left, size = rule[order], at[order], left[order], size[order]
    head = np.flatnonzero(np.diff(rule, prepend=-1))                                      # first derivation of each rule
    lo, m, hi = tree_nodes(start, length, edges, least)
    lo, m, hi = (np.concatenate(x) for x in ((at[head], lo), (at[head] + left[head], m), (at[head] + size[head], hi)))
    node, first, after, q = runs_at(lo, m, hi, sym, least, periods)
    for i in range(len(node)):                                                            # hashes only propose
        if not np.array_equal(sym[first[i]:after[i] - q[i]], sym[first[i] + q[i]:after[i]]):
            raise ArithmeticError("two unequal word sequences share both hashes")
    uses = np.append(np.diff(np.append(head, len(rule))), np.ones(len(lo) - len(head), np.int64))
    n = uses[node]
    which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    moved = np.zeros(len(which), np.int64)
    of_rule = np.repeat(node < len(head), n)
    own = np.repeat(np.where(node < len(head), np.append(head, 0)[np.minimum(node, len(head))], 0), n)
    moved[of_rule] = (at[own[of_rule] + which[of_rule]] - at[own[of_rule]])
    return maximal(np.repeat(first, n) + moved, np.repeat(after, n) + moved, np.repeat(q, n))


def _slabs(batches, size: int) -> Iterator[list[tuple]]:
    """Lists of (id, words) of about ``size`` words; a long text is a list by itself."""
    held, n = [], 0
    for b in batches:
        for key, text in zip(*(c.to_pylist() for c in b.columns)):
            words = text.split() if text else []
            if held and n + len(words) > size:
                yield held
                held, n = [], 0
            held.append((key, words))
            n += len(words)
    if held:
        yield held


def _drop(words: list[bytes], runs: list[dict]) -> bytes:
    """The words outside ``runs`` after their first period, joined by one space."""
    steps = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        steps[r["start"] + r["period"]] += 1
        steps[r["start"] + r["length"]] -= 1
    gone = np.cumsum(steps[:-1]) > 0
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                  min_periods: int = MIN_PERIODS, slab_words: int = SLAB_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``id, n_words, runs array<struct<start, length,
    period>>, collapsed``: the runs by start, then period, and the words outside all
    runs after their first period, joined by one space.

    Words are what ASCII white space separates.  A run is a stretch of words with
    smallest period q and length >= max(``min_words``, ``min_periods`` * q) that no neighbouring word extends.
    Null and empty texts have no words and no runs.  Ids may be null or
    repeated, each row stands for itself.  Only the two columns are read, so
    others may have any name.
    """
    if min_periods < 3 or min_words < 8 * min_periods:
        raise ValueError("a run needs three periods, and eight words for each")

    def run(batches):
        for slab in _slabs(batches, slab_words):
            words = list(chain.from_iterable(w for _, w in slab))
            known = {w: i for i, w in enumerate(dict.fromkeys(words))}
            sym = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            edges = np.concatenate([[0], np.cumsum([len(w) for _, w in slab])]).astype(np.int64)
            first, after, q = find_runs(sym, edges, min_words, min_periods)
            runs = [[] for _ in slab]
            order = np.lexsort((q, first))
            owner = np.searchsorted(edges, first[order], "right") - 1
            for d, f, a, p in zip(owner.tolist(), first[order].tolist(), after[order].tolist(), q[order].tolist()):
                runs[d].append({"start": f - int(edges[d]), "length": a - f, "period": p})
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in slab], pa.int64()), pa.array([len(w) for _, w in slab], pa.int64()), pa.array(runs, _RUNS),
                 pa.array([_drop(w, r) if r else b" ".join(w) for (_, w), r in zip(slab, runs)], pa.binary())],
                names=["id", "n_words", "runs", "collapsed"])

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(run, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
            .withColumn("collapsed", F.col("collapsed").cast("string")))

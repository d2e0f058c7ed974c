"""Spelling variants: words one edit apart, found in k-d trees over letter counts.

A word's vector counts its letters.  Words of one length that differ in one
letter are at L1 distance two (one count up, one down); a word and the same with
one letter more are at distance one (one count up).  So per length pair a word
searches the tree of its own length with one step up and one down, and the tree
of the next length with one step up.  A box is pruned when its bounds ask for
more steps.  What remains is checked by parity of the counts, by L1 distance and
at last by the order of the letters.

Two levels.  A shallow tree per length, fitted on a bounded sample, deals the
words to cells of bounded size (the boxes that a word's search touches); each
cell builds its own deep tree over its words.  Cells return one row per word
that has near words: their number and the best of them.  Pairs never leave a cell.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import Cells, bounded_sample, stored

MIN_LETTERS, MIN_COUNT, RATIO = 7, 2, 10
#: Words of the sample that fits the shallow trees; words of a box; words of a cell's leaf.
SAMPLE_WORDS, BOX_WORDS, LEAF_WORDS = 32_768, 32_768, 16
#: Distinct words that a task counts before it passes them on; queries searched at once; candidates, then bytes compared at once.
COUNTED, CHUNK, CANDIDATES, BYTES = 400_000, 2_048, 2_000_000, 16_000_000
#: Letters: a-z and U+00C0 to U+00FF.
LETTERS = 26 + 64
_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = np.arange(26)
_CODE[0xC0:0x100] = 26 + np.arange(64)
#: Number of boxes that one length can have (leaf id = length * BOXES + box).
BOXES = 1 << 20


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS,
                  min_count: int = MIN_COUNT, drop_every: int | None = None) -> DataFrame:
    """``(word, n)``: the letter runs of all whole texts, A-Z lower-cased, of
    ``min_letters`` or more code points and ``min_count`` or more occurrences.

    ``drop_every`` plants errors: a run of which that number divides
    h = crc32 of ``id:run`` loses its code point at h modulo its length.  Null
    and empty texts have no words; in a row with a null id nothing is planted.
    """
    letters = re.compile(f"[a-zÀ-ÿ]{{{min_letters},}}")

    def run(batches):
        total: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                              names=["word", "n"])
        for b in batches:
            for key, text in zip(*(c.to_pylist() for c in b.columns)):
                found = letters.findall(text.lower().decode("utf-8", "replace")) if text else ()
                if not drop_every or key is None:
                    total.update(found)
                else:
                    head = zlib.crc32(b"%d:" % key)
                    for w, n in Counter(found).items():
                        h = zlib.crc32(w.encode(), head)
                        if h % drop_every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1:]
                        if len(w) >= min_letters:
                            total[w] += n
                if len(total) >= COUNTED:
                    yield rows()
                    total.clear()
        if total:
            yield rows()

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all words in a row, and the edges of the words."""
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return _CODE[flat], np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def vectors_of(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Letter counts (words x letters); counts above 255 stay at 255, which only widens a search."""
    n = len(edges) - 1
    row = np.repeat(np.arange(n), np.diff(edges))
    out = np.zeros((n, LETTERS), np.uint8)
    for i in range(0, n, 65_536):
        part = slice(edges[i], edges[min(n, i + 65_536)])
        k = min(n, i + 65_536) - i
        out[i:i + k] = np.bincount((row[part] - i) * LETTERS + codes[part], minlength=k * LETTERS).reshape(k, LETTERS).clip(0, 255)
    return out


@dataclass
class KdTree:
    """Inner node i: letter ``dim[i]``, left when count <= ``cut[i]``, children
    ``left[i]``, ``right[i]``; a child below zero is the leaf ``-1 - child``."""
    dim: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    root: int = -1

    @classmethod
    def fit(cls, x: np.ndarray, leaf_words: float) -> "KdTree":
        """Every node is cut at the letter and count that halve its words best.
        Words of equal counts cannot be cut; they share a leaf."""
        tree = cls()
        todo = [(np.arange(len(x)), None, None)]
        while todo:
            own, parent, side = todo.pop()
            node = None
            if len(own) > leaf_words:
                part = x[own]
                best = (0, 0, 0)
                for t in range(4):
                    below = np.count_nonzero(part <= t, axis=0)
                    score = np.minimum(below, len(own) - below)
                    d = int(score.argmax())
                    best = max(best, (int(score[d]), d, t))
                if not best[0]:                      # all counts above three agree or none differs
                    low, high = part.min(0), part.max(0)
                    d = int((high.astype(int) - low).argmax())
                    best = (int(high[d] > low[d]), d, int((int(low[d]) + int(high[d])) // 2))
                if best[0]:
                    node = len(tree.dim)
                    tree.dim.append(best[1])
                    tree.cut.append(best[2])
                    tree.left.append(0)
                    tree.right.append(0)
                    low = part[:, best[1]] <= best[2]
                    todo += [(own[~low], node, tree.right), (own[low], node, tree.left)]
            if node is None:
                node = -1 - len(tree.leaves)
                tree.leaves.append(own)
            if parent is None:
                tree.root = node
            else:
                side[parent] = node
        return tree

    def arrays(self) -> "KdTree":
        self.dim, self.cut, self.left, self.right = (np.array(a, np.int64) for a in (self.dim, self.cut, self.left, self.right))
        return self

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), self.root)
        while (at := np.flatnonzero(node >= 0)).size:
            n = node[at]
            node[at] = np.where(x[at, self.dim[n]] <= self.cut[n], self.left[n], self.right[n])
        return -1 - node

    def touched(self, x: np.ndarray, down: bool) -> tuple[np.ndarray, np.ndarray]:
        """(word, leaf) of the boxes within one step up and, if ``down``, one step down."""
        word, node = np.arange(len(x)), np.full(len(x), self.root)
        up, dn = np.ones(len(x), bool), np.full(len(x), down)
        words, leaves = [], []
        while len(word):
            end = node < 0
            words.append(word[end])
            leaves.append(-1 - node[end])
            word, node, up, dn = word[~end], node[~end], up[~end], dn[~end]
            over = x[word, self.dim[node]].astype(np.int64) - self.cut[node]
            # to the left: count <= cut, at most one too many; to the right: one too few
            l, r = (over <= 0) | ((over == 1) & dn), (over > 0) | ((over == 0) & up)
            word, node, up, dn = (np.concatenate([word[l], word[r]]), np.concatenate([self.left[node[l]], self.right[node[r]]]),
                                  np.concatenate([up[l], up[r] & (over[r] > 0)]), np.concatenate([dn[l] & (over[l] <= 0), dn[r]]))
        return np.concatenate(words), np.concatenate(leaves)


class Boxes:
    """The shallow trees by length; a length without one has a single box."""

    def __init__(self, trees: dict[int, KdTree]):
        self.trees = trees

    def home(self, length: int, x: np.ndarray) -> np.ndarray:
        tree = self.trees.get(length)
        return length * BOXES + (tree.home(x) if tree else np.zeros(len(x), np.int64))

    def visits(self, length: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, box) beside the own box: boxes of the own length with a higher
        number, and all touched boxes of the next length."""
        out = []
        for other in (length, length + 1):
            tree = self.trees.get(other)
            at, leaf = tree.touched(x, other == length) if tree else (np.arange(len(x)), np.zeros(len(x), np.int64))
            if other == length:
                above = leaf > (tree.home(x)[at] if tree else 0)
                at, leaf = at[above], leaf[above]
            out.append((at, other * BOXES + leaf))
        return tuple(np.concatenate(x) for x in zip(*out))


def _by_length(words: list[str]):
    """(length, rows of that length) for each length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size).tolist():
        yield n, np.flatnonzero(size == n)


def _vectors(words: list[str]) -> np.ndarray:
    return vectors_of(*codes_of(words))


def _parity(x: np.ndarray) -> np.ndarray:
    """Parities of the counts, folded into 64 bits: a step flips one bit."""
    weight = np.uint64(1) << (np.arange(LETTERS) % 64).astype(np.uint64)
    out = np.zeros(len(x), np.uint64)
    for d in range(LETTERS):
        out ^= np.where(x[:, d] & 1, weight[d], np.uint64(0))
    return out


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of letter codes, b as long as a or one longer: True where one
    edit makes b of a (common beginning and end cover all but that letter)."""
    k, longer = a.shape[1], b.shape[1] - a.shape[1]
    head, tail = a == b[:, :k], a == b[:, longer:]
    ahead = np.where(head.all(1), k, head.argmin(1))
    behind = np.where(tail.all(1), k, tail[:, ::-1].argmin(1))
    return ahead + behind >= k if longer else (ahead + behind == k - 1)


def near_pairs(queries: list[str], data: list[str], same: bool):
    """Yield (query, data) index arrays of the pairs one edit apart.  All data
    words have one length, all queries that length or one less; ``same``: both
    lists are the same, each pair comes once."""
    codes, edges = codes_of(data)
    x = vectors_of(codes, edges)
    tree, parity, width = KdTree.fit(x, LEAF_WORDS).arrays(), _parity(x), len(data[0])
    members = np.concatenate(tree.leaves)
    size = np.array([len(m) for m in tree.leaves])
    begin = np.cumsum(size) - size
    codes = codes.reshape(-1, width)
    for i in range(0, len(queries), CHUNK):
        part = queries[i:i + CHUNK]
        qcodes, qedges = codes_of(part)
        qx = vectors_of(qcodes, qedges)
        k = len(part[0])
        at, leaf = tree.touched(qx, down=k == width)
        qparity, qcodes = _parity(qx), qcodes.reshape(-1, k)
        total = np.concatenate([[0], np.cumsum(size[leaf])])
        cut = np.unique(np.searchsorted(total, np.arange(0, total[-1] + CANDIDATES, CANDIDATES)).clip(0, len(leaf)))
        steps, step = (2 if k == width else 1), max(1, BYTES // (LETTERS + 2 * width))
        for f, g in zip(cut[:-1], np.append(cut[1:-1], len(leaf))):
            n = size[leaf[f:g]]
            own = np.repeat(at[f:g], n)
            other = members[np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[leaf[f:g]], n)]
            good = np.bitwise_count(qparity[own] ^ parity[other]) <= steps
            if same:
                good &= other > own + i
            own, other = own[good], other[good]
            for j in range(0, len(own), step):
                a, b = own[j:j + step], other[j:j + step]
                good = np.abs(qx[a].astype(np.int16) - x[b]).sum(1) <= steps
                a, b = a[good], b[good]
                good = one_edit(qcodes[a], codes[b])
                yield a[good] + i, b[good]


def near_words(vocabulary: DataFrame, sample_words: int = SAMPLE_WORDS, box_words: int = BOX_WORDS,
               cell_words: int | None = None) -> DataFrame:
    """``vocabulary(word, n)`` with distinct words -> ``(word, n_near, form, form_n)``
    for the words that have a near word; form is the near word of largest n
    (ties: smallest in code-point order).

    The driver holds the counts of long lists of one length, trees fitted on at
    most ``sample_words`` count vectors, and two numbers per box.  Long words
    cost their length in each cell that they visit.
    """
    lengths = {r.size: r.n for r in vocabulary.groupBy(F.length("word").alias("size")).agg(F.count(F.lit(1)).alias("n"))
               .where(F.col("n") > box_words).collect()}                  # at most words / box_words rows
    trees = {}
    if lengths:
        def vectors(batches):
            for b in batches:
                words = b.column(0).to_pylist()
                x = _vectors(words)
                yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in words], pa.int64()), pa.array([v.tobytes() for v in x], pa.binary())],
                                                 names=["size", "x"])
        drawn = bounded_sample(vocabulary.where(F.length("word").isin(list(lengths))).select("word"), "word", sample_words)
        found = drawn.mapInArrow(vectors, "size long, x binary").toArrow()
        sizes = found.column("size").to_numpy()
        x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.uint8).reshape(-1, LETTERS)
        for size, n in lengths.items():
            own = x[sizes == size]
            leaves = min(BOXES, -(-n // box_words))
            trees[size] = KdTree.fit(own, max(4, len(own) / leaves)).arrays()
            trees[size].leaves = []
    boxes = Boxes(trees)

    def count(batches):
        for b in batches:
            words = b.column(0).to_pylist()
            home, visit = Counter(), Counter()
            for size, rows in _by_length(words):
                x = _vectors([words[i] for i in rows])
                for into, leaf in ((home, boxes.home(size, x)), (visit, boxes.visits(size, x)[1])):
                    into.update(dict(zip(*(v.tolist() for v in np.unique(leaf, return_counts=True)))))
            rows = [(leaf, home[leaf], visit[leaf]) for leaf in home | visit]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=["leaf", "home", "visit"])

    counts = (vocabulary.select("word").mapInArrow(count, "leaf long, home long, visit long")
              .groupBy("leaf").agg(F.sum("home").alias("home"), F.sum("visit").alias("visit")).collect())     # a row per box
    cells = Cells({r.leaf: r.home for r in counts if r.home}, {r.leaf: r.visit for r in counts if r.visit},
                  *([cell_words] if cell_words else []))

    def deal(batches):
        for b in batches:
            words = b.column(0).to_pylist()
            salt = np.array([zlib.crc32(w.encode()) for w in words], np.int64)
            for size, rows in _by_length(words):
                x = _vectors([words[i] for i in rows])
                at, leaf = boxes.visits(size, x)
                for idx, (i, box, p, q, asks) in ((rows, cells.deal(boxes.home(size, x), salt[rows], False)),
                                                  (rows[at], cells.deal(leaf, salt[rows[at]], True))):
                    for k in range(0, len(i), 20_000):
                        part = slice(k, k + 20_000)
                        take = pa.array(idx[i[part]])
                        yield pa.RecordBatch.from_arrays([pa.array(box[part]), pa.array(p[part]), pa.array(q[part]), pa.array(asks[part]),
                                                          b.column(0).take(take), b.column(1).take(take)],
                                                         names=["box", "x", "y", "query", "word", "n"])

    def search(key, t):
        size, diagonal = key[0].as_py() // BOXES, key[1].as_py() == key[2].as_py()
        t = t.sort_by("word")
        words, n = np.array(t.column("word").to_pylist(), object), t.column("n").to_numpy()
        asks = t.column("query").to_numpy(zero_copy_only=False)
        data = np.flatnonzero(~asks)
        found, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
        # order of preference: larger n, then smaller word (rows are sorted by word)
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((-np.arange(len(words)), n))] = np.arange(len(words))
        if len(data):
            asked = [data] if diagonal else [np.flatnonzero(asks & (np.fromiter(map(len, words), np.int64, len(words)) == k)) for k in (size, size - 1)]
            for own in asked:
                if not len(own):
                    continue
                for a, b in near_pairs(words[own].tolist(), words[data].tolist(), diagonal):
                    a, b = own[a], data[b]
                    for u, v in ((a, b), (b, a)):
                        np.add.at(found, u, 1)
                        np.maximum.at(best, u, rank[v])
        at = np.argsort(rank)
        hit = np.flatnonzero(found)
        form = at[best[hit]]
        return pa.table({"word": pa.array(words[hit], pa.string()), "found": found[hit], "form": pa.array(words[form], pa.string()), "form_n": n[form]},
                        schema=pa.schema([("word", "string"), ("found", "int64"), ("form", "string"), ("form_n", "int64")]))

    parts = (vocabulary.select("word", "n").mapInArrow(deal, "box long, x long, y long, query boolean, word string, n long")
             .groupBy("box", "x", "y").applyInArrow(search, "word string, found long, form string, form_n long"))
    best = F.min(F.struct((-F.col("form_n")).alias("order"), "form"))
    return parts.groupBy("word").agg(F.sum("found").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.order")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms(word, form)``, one form per word and no circle -> ``(word, root)``,
    the last word of each chain, by doubling: a chain of k words takes log2(k) rounds."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                            F.col("next").isNotNull().alias("moved")))
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def group(vocabulary: DataFrame, ratio: int = RATIO, **options) -> DataFrame:
    """``vocabulary(word, n)`` -> ``word, form, root, n, n_near, form_n``.

    Two words are near if one inserted, deleted or replaced letter makes one of
    the other.  A word's form is its most frequent near word (ties: smallest in
    code-point order) if that is ``ratio`` times as frequent at least, else
    null; root follows the forms to the last word, the word itself if it has no
    form.  Words are distinct, made of a-z and U+00C0 to U+00FF, with n above
    zero; null words and an empty table give no rows.  ``ratio`` is two or more,
    so counts rise along a chain and it ends.
    """
    if ratio < 2:
        raise ValueError("ratio must be two or more")
    vocabulary = stored(vocabulary.where("word IS NOT NULL").select("word", "n"))
    near = near_words(vocabulary, **options)
    far = F.col("form_n") >= ratio * F.col("n")
    out = stored(vocabulary.join(near, "word", "left").select(
        "word", F.when(far, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(far, F.col("form_n")).alias("form_n")))
    last = roots(out.where("form IS NOT NULL").select("word", "form"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

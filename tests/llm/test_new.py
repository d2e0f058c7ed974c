"""Runs, spelling variants and quality scores against brute force; odd rows."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from pyspark.sql import functions as F
from tidemark.llm import grammar_runs, quality_rff, queries, spelling_kd

from ..conftest import SF_SMALL

DOCS = "doc_id long, text string"
ODD = {"word": "x", "runs": 1, "stats": 2, "a.b": 3, "n": 4, "id": "q", "score": 5}


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS).withColumns({k: F.lit(v) for k, v in ODD.items()})


# ---- periodic runs

def plain_runs(w, least=24, periods=3):
    """Every period by itself: stretches of w[i] == w[i + q], smallest period per stretch."""
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, periods * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic_text(rng):
    k, out = rng.choice([1, 2, 3, 5, 40]), []
    for _ in range(rng.randrange(1, 6)):
        if rng.random() < 0.4:
            out += [f"w{rng.randrange(k)}" for _ in range(rng.randrange(60))]
        else:
            out += ([f"w{rng.randrange(k)}" for _ in range(rng.randrange(1, 30))] * rng.randrange(1, 15))[:rng.randrange(1, 200)]
    return out


def test_runs_match_a_plain_search_on_every_grammar():
    rng = random.Random(1)
    for _ in range(150):
        docs = [periodic_text(rng) for _ in range(rng.randrange(1, 8))]
        known = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
        sym = np.array([known[w] for d in docs for w in d], np.int64)
        edges = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        f, a, q = grammar_runs.find_runs(sym, edges)
        want = [(s + int(edges[i]), n, p) for i, d in enumerate(docs) for s, n, p in plain_runs(d)]
        assert sorted(zip(f.tolist(), (a - f).tolist(), q.tolist())) == sorted(want)


def test_grammar_spells_the_text():
    rng = random.Random(2)
    for _ in range(30):
        w = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 400))], np.int64)
        (rule, at, left, size), (start, length) = grammar_runs.repair(w, np.zeros(len(w), np.int64))
        assert start[0] == 0 and np.array_equal(start[1:], (start + length)[:-1]) and start[-1] + length[-1] == len(w)
        for r in set(rule.tolist()):
            own = rule == r
            assert own.sum() > 1 and len({(tuple(w[a:a + n]), k) for a, n, k in zip(at[own], size[own], left[own])}) == 1
    w = np.array([1, 2, 3, 4, 5, 6, 7] * 1000, np.int64)
    assert len(grammar_runs.repair(w, np.zeros(len(w), np.int64))[1][0]) < 20


@pytest.mark.parametrize("words", [[1] * 5000, [1, 2, 3] * 700, [bin(i).count("1") % 2 for i in range(4096)]])
def test_runs_of_long_regular_texts(words):
    f, a, q = grammar_runs.find_runs(np.array(words, np.int64), np.array([0, len(words)]))
    assert sorted(zip(f.tolist(), (a - f).tolist(), q.tolist())) == plain_runs(words)


def test_runs_of_odd_rows(spark):
    long = "x " * 30_000
    texts = [None, "", " \t\n ", "a " * 24, "a " * 23, ("a b c d e f g h " * 3).strip(), long, "a " * 24, "ß\x0bß " * 12]
    got = {r.id: r for r in grammar_runs.periodic_runs(docs_of(spark, texts), slab_words=40).collect()}
    assert [len(got[i].runs) for i in range(9)] == [0, 0, 0, 1, 0, 1, 1, 1, 1]
    assert got[0].n_words == 0 and got[0].collapsed == "" and got[6].collapsed == "x" and got[6].runs[0].length == 30_000
    assert got[5].collapsed == "a b c d e f g h" and got[4].collapsed == " ".join(["a"] * 23)
    assert grammar_runs.periodic_runs(docs_of(spark, ["a"]).limit(0)).count() == 0
    ids = spark.createDataFrame([(None, "a " * 30), (1, "b"), (1, "b")], DOCS)
    assert sorted((r.id or 0, len(r.runs)) for r in grammar_runs.periodic_runs(ids).collect()) == [(0, 1), (1, 0), (1, 0)]


def test_op11_query_against_a_plain_computation(spark):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    some = 0
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h = zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = plain_runs(w)
        some += bool(runs)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    assert some > 10


# ---- spelling variants

def edited(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(count, ratio=10):
    near = defaultdict(list)
    for a in count:
        for b in count:
            if edited(a, b):
                near[a].append(b)
    form = {}
    for w in count:
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, len(near[w]), count[form[w]] if form[w] else None) for w, n in count.items()}


@pytest.mark.parametrize("options", [{}, {"box_words": 40, "cell_words": 25, "sample_words": 60}])
def test_variants_match_all_pairs(spark, options):
    rng = random.Random(5)
    count = {}
    for _ in range(500):
        w = "".join(rng.choice("abcé") for _ in range(rng.randrange(3, 7)))
        count[w] = 10 ** rng.randrange(5) * rng.randrange(1, 4)
    count.update({"a" * 300: 50, "a" * 299 + "b": 5, "a" * 301: 5, "abab" * 70: 3, "baba" * 70: 3})
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    got = spelling_kd.group(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(count) and {tuple(r) for r in got} == plain_variants(count)


def test_variants_of_odd_rows(spark):
    texts = [None, "", "STRASSEN straßen Straßen, straßén×straßen strassen", "Überall ÜBERALL überall", "sixsix " * 3, "sevenly\x00sevenly"]
    got = {r.word: r.n for r in spelling_kd.counted_words(docs_of(spark, texts)).collect()}
    assert got == {"strassen": 2, "straßen": 2, "Überall": 2, "sevenly": 2}
    assert spelling_kd.group(spark.createDataFrame([], "word string, n long")).count() == 0
    same = spelling_kd.group(spark.createDataFrame([("abcdefg", 20), ("abcdefh", 20), ("abcdefi", 2), (None, 1)], "word string, n long"))
    assert {r.word: (r.form, r.n_near) for r in same.collect()} == {"abcdefg": (None, 2), "abcdefh": (None, 2), "abcdefi": ("abcdefg", 2)}


def test_op12_query_against_all_pairs(spark):
    count = Counter()
    for d in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", d.text or ""):
            w = re.sub("[A-Z]+", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{d.doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    got = queries.op12_spelling_variants(spark, SF_SMALL).collect()
    # deletion and wildcard keys find the near words of all words without pairs
    near = defaultdict(set)
    keys = defaultdict(set)
    for w in count:
        for i in range(len(w)):
            keys[w[:i] + "*" + w[i + 1:]].add(w)
            keys[w[:i] + w[i + 1:]].add(w)
        keys[w].add(w)
    for group in keys.values():
        for a in group:
            near[a] |= {b for b in group if edited(a, b)}
    assert {r.word: (r.n, r.n_near) for r in got} == {w: (n, len(near[w])) for w, n in count.items()}
    for r in got:
        best = min(near[r.word], key=lambda v: (-count[v], v), default=None)
        assert (r.form, r.form_n) == ((best, count[best]) if best and count[best] >= 10 * r.n else (None, None))


# ---- quality

def test_normal_equations_and_isotonic_match_dense_algebra(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, quality_rff.STATISTICS)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    stats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, stats array<float>").repartition(5)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    model = quality_rff.fit(stats, labels, features=64, folds=1, ridge=1e-3)
    z = model.features(x.astype(float))
    penalty = np.full(65, 1e-3 * 300 + 1e-9 * 300)
    penalty[-1] = 1e-9 * 300
    want = np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ y)
    assert np.allclose(model.weights, want, atol=1e-6)
    assert np.allclose(model.features.mean, x.mean(0), atol=1e-5) and np.allclose(model.features.scale, x.std(0), atol=1e-4)
    at, rate = quality_rff.isotonic(np.arange(6.0), np.array([1, 1, 2, 1, 1, 4.0]), np.array([0, 1, 0, 1, 0, 4.0]))
    # brute force: min over upper, max over lower means
    n, t = np.array([1, 1, 2, 1, 1, 4.0]), np.array([0, 1, 0, 1, 0, 4.0])
    plain = [max(min(t[a:b + 1].sum() / n[a:b + 1].sum() for b in range(i, 6)) for a in range(i + 1)) for i in range(6)]
    assert np.allclose(np.interp(np.arange(6.0), at, rate), plain)


def test_kernel_is_approximated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, quality_rff.STATISTICS)) * 0.5
    f = quality_rff.Features.fit(x.mean(0), x.std(0), x, 4096, 3)
    z, u = f(x)[:, :-1], np.clip((x - f.mean) / f.scale, -quality_rff.CLIP, quality_rff.CLIP)
    far = ((u[:, None] - u[None]) ** 2).sum(2)
    width = 1 / f.weights.std()
    assert np.abs(z @ z.T - np.exp(-far / (2 * width ** 2))).max() < 0.12


def test_quality_of_odd_rows(spark):
    docs = docs_of(spark, [None, "", " ", "one two three", "x" * 300_000, "!!!! " * 500, "one two three"])
    stats = quality_rff.statistics(docs)
    rows = {r.id: r.stats for r in stats.collect()}
    assert len(rows) == 7 and not any(rows[0]) and rows[3] == rows[6] and all(np.isfinite(v).all() for v in map(np.array, rows.values()))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_rff.score(stats, quality_rff.fit(stats, none)).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (4, None), (None, 0), (99, 0)], "doc_id long, quality int")
    assert {r.score for r in quality_rff.score(stats, quality_rff.fit(stats, one)).collect()} == {1.0}
    two = spark.createDataFrame([(3, 1), (6, 1), (5, 0), (4, 0), (3, 1)], "doc_id long, quality int")
    found = {r.id: r.score for r in quality_rff.score(stats, quality_rff.fit(stats, two)).collect()}
    assert len(found) == 7 and all(0 <= s <= 1 for s in found.values())
    assert quality_rff.statistics(docs.limit(0)).count() == 0


def test_op13_ranks_held_out_documents(spark):
    sf = SF_SMALL.replace("0.001", "0.1")
    got = queries.op13_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    keep = {q: np.mean([r.predicted for r in got if r.quality == q]) for q in (0, 1)}
    assert keep[1] > 0.99 and keep[0] < 0.1

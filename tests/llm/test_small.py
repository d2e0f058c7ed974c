"""Small fixtures: brute force, nulls, empties, ties, repeats, clashing names."""
import hashlib
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from tidemark.llm import (hamming_topk, mixing, pieces, pq_dedup, secret_scan, sharding, simhash_vp, substring_dedup,
                          toxicity, url_lists)
from tidemark.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=True):
    rows = [(i, t, "en", f"s{i % 3}", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    # names that the operators use themselves, and one with a dot
    return df.withColumns({"fp": F.lit(1), "row": F.lit("x"), "words": F.lit(2), "a.b": F.lit(3), "rank": F.lit(4)}) if extra else df


def prose(rng, n, words=60):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def linked(n, near):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(n):
        for b in range(a):
            if near(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_components_follow_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# ---- url lists

def test_url_keys_intervals_and_odd_rows(spark):
    import datetime as dt
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    entries = spark.createDataFrame([
        ("b.com", "block", day(10)), ("b.com", "remove", day(20)), ("a.b.com/x", "allow", day(12)), ("b.com", "block", day(30)),
        ("b.com", "allow", day(30)), ("c.com", "nonsense", day(1)), (None, "block", day(1)), ("d.com", "block", None),
        ("localhost", "block", day(0))], "key string, action string, listed date")
    caps = [("https://A.b.com/x/y", 15), ("https://a.b.com/z", 15), ("http://u:p@a.b.com:80/z", 9), ("http://a.b.com", 20),
            ("http://b.com./", 30), (None, 15), ("", 15), ("nohost", 15), ("http://c.com", 5), ("http://d.com", 5),
            ("http://localhost/q", 1), ("http://a.b.com/z", None), ("https://a.b.com/z", 15)]
    df = spark.createDataFrame([(i, u, None if d is None else day(d), 9) for i, (u, d) in enumerate(caps)],
                               "page_id long, url string, fetch_date date, verdict int")
    got = {r.page_id: (r.verdict, r.matched_key) for r in url_lists.evaluate(df, entries).collect()}
    none = ("none", None)
    assert got == {0: ("allow", "a.b.com/x"), 1: ("block", "b.com"), 2: none, 3: none, 4: ("allow", "b.com"), 5: none, 6: none,
                   7: none, 8: none, 9: none, 10: ("block", "localhost"), 11: none, 12: ("block", "b.com")}
    assert url_lists.evaluate(df.limit(0), entries).count() == 0
    assert {r.verdict for r in url_lists.evaluate(df, entries.limit(0)).collect()} == {"none"}


def test_urls_of_many_labels_are_looked_up_whole(spark):
    import datetime as dt
    host = "a.b.c.d.e.f.g.spam.example.com"
    rows = [(host, "block"), ("c.d.e.f.g.spam.example.com", "allow"), ("x." + host, "allow"), ("x." + host + "/in", "block")]
    entries = spark.createDataFrame([(*r, dt.date(2024, 1, 1)) for r in rows], "key string, action string, listed date")
    hosts = [host, "y." + host, "b.c.d.e.f.g.spam.example.com", "x." + host, "x." + host + "/in/z", ".".join("l" * 117) + "." + host]
    caps = spark.createDataFrame([(i, f"http://{h}", dt.date(2024, 2, 1)) for i, h in enumerate(hosts)], "page_id long, url string, fetch_date date")
    got = [(r.verdict, r.matched_key) for r in sorted(url_lists.evaluate(caps, entries).collect())]
    assert got == [("block", host), ("block", host), ("allow", rows[1][0]), ("allow", rows[2][0]), ("block", rows[3][0]), ("block", host)]


# ---- top-k

def test_topk_equals_brute_force_with_copies_and_ties(spark):
    rng = random.Random(3)
    codes = [rng.getrandbits(64) for _ in range(150)] + [5] * 60 + [0, (1 << 64) - 1]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, code long")
    got = {}
    for r in hamming_topk.top_k(df, hamming_topk.every_nth(df, 10), k=7, block_codes=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.id))
    for q in range(0, len(codes), 10):
        best = sorted((bin(codes[q] ^ c).count("1"), i) for i, c in enumerate(codes) if i != q)[:7]
        assert sorted(got[q]) == [(n + 1, d, i) for n, (d, i) in enumerate(best)]


def test_topk_is_full_for_an_id_with_several_codes(spark):
    rng = random.Random(4)
    rows = [(0, c) for c in (0, 1, 2, 4, 8)] + [(i, rng.getrandbits(62)) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "id long, code long")
    got = {}
    for r in hamming_topk.top_k(df, df.where("id = 0 AND code = 0 OR id = 20"), k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.id))
    for q, code in (rows[0], rows[24]):
        best = sorted((bin(code ^ c).count("1"), i) for i, c in dict.fromkeys(rows) if i != q)
        best = [x for n, x in enumerate(best) if x not in best[:n]][:7]
        assert sorted(got[q]) == [(n + 1, d, i) for n, (d, i) in enumerate(best)]


def test_topk_of_few_null_and_short_vectors(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, [1.0, -1.0]), (20, None), (40, [nan, None, 2.0]), (60, []), (None, [1.0])], "vec_id long, embedding array<float>")
    codes = hamming_topk.sign_codes(df)
    assert {r.id: r.code for r in codes.collect()} == {0: 1, 40: 4, 60: 0}
    got = [tuple(r) for r in hamming_topk.top_k(codes, hamming_topk.every_nth(codes)).collect()]
    assert sorted(got) == [(0, 1, 60, 1), (0, 2, 40, 2), (40, 1, 60, 1), (40, 2, 0, 2), (60, 1, 0, 1), (60, 2, 40, 1)]
    assert hamming_topk.top_k(codes.limit(0), codes.limit(0)).count() == 0


# ---- pieces

@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL_PATH, "rb") as f:
        return pieces.Vocabulary.parse(f.read())


def test_viterbi_finds_the_best_sum(vocabulary):
    v = vocabulary
    found = {}
    with open(pieces.MODEL_PATH, "rb") as f:
        for number, value in pieces._fields(f.read()):
            if number == 1:
                d = dict(pieces._fields(value))
                found[d[1].decode()] = (len(found), d.get(3, 1))
    score = {p: v.scores[i] for p, (i, kind) in found.items() if kind == pieces.NORMAL}
    longest = max(map(len, score))

    def best(text):
        s = [0.0] + [-np.inf] * len(text)
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + longest) + 1):
                gain = score.get(text[i:j], v.unknown_score if j == i + 1 else -np.inf)
                s[j] = max(s[j], s[i] + gain)
        return s[-1]

    rng = random.Random(1)
    words = ["the", "unbelievably", "über", "☃", "x☃y", "日本語", "𝔘𝔘", "a1b2c3", "----", "\n\n\t", "Straße" * 5]
    words += ["".join(rng.choice("abcdeéß. ") for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    for w in words:
        ids = np.frombuffer(v.encode([w.encode()])[0], np.int32).tolist()
        bytes_ = set(v.byte_ids.tolist())
        runs = re.sub("B+", lambda m: "B" * 1, "".join("B" if i in bytes_ else "p" for i in ids))
        assert runs
        total = sum(v.scores[i] for i in ids if i not in bytes_)
        lone = len(b"".join(v.pieces[i] for i in ids if i in bytes_).decode())
        assert total + lone * v.unknown_score == best("▁" + w.replace(" ", "▁"))
        assert v.decode(ids) == w


def test_single_words_agree_with_the_lattice_of_the_library(vocabulary):
    import sentencepiece
    with open(pieces.MODEL_PATH, "rb") as f:
        lib = sentencepiece.SentencePieceProcessor(model_proto=f.read() + bytes([0x12, 2, 0x18, 1]))   # unigram decoding
    for w in ["the", "hand", "with", "house", "tionheren", "ich"]:
        ids = np.frombuffer(vocabulary.encode([w.encode()])[0], np.int32).tolist()
        scores = [sum(vocabulary.scores[i] for i in x) for x in lib.nbest_encode_as_ids(w, 8)]
        assert sum(vocabulary.scores[i] for i in ids) == max(scores)


def test_encode_and_decode_columns(spark):
    v = pieces.load(spark)
    texts = ["a  b", "", None, "  lead", "trail ", "é☃𝔘\x00\r\n", "a" * 30_000, "x y " * 5_000, "a  b", "▁ mark"]
    df = pieces.decode(pieces.encode(docs_of(spark, texts), v), v)
    for r in df.collect():
        want = texts[r.doc_id]
        assert (r.ids is None) == (want is None)
        assert r.decoded == (None if want is None else want.replace("▁", " "))
    assert pieces.encode(docs_of(spark, ["x"]).limit(0), v).count() == 0


# ---- secrets

def spans_by_hand(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_spans_and_redaction(spark):
    hexes = hashlib.sha256(b"x").hexdigest()
    texts = [f"pass 𝔘é PassWord: '{hexes}' end", "secret: token: abcdefgh", "token=abc token=abcdef", "AKIA" + "Q" * 15 + " AKIA" + "Z9" * 10,
             hexes[:23] + " " + hexes[:24], None, "", "api_key=" + hexes[:30] + "apikey = k.k_k-k=k", "API-KEY=abcdefghi", hexes * 3,
             f"pass 𝔘é PassWord: '{hexes}' end", "plain text " * 2000, "ſecret=abcdefgh"]
    got = secret_scan.with_spans(docs_of(spark, texts), thresholds={})
    for r in got.collect():
        t = texts[r.doc_id] or ""
        assert [(x.s, x.k, x.e) for x in r.secret_base] == spans_by_hand(t), t
    for r in secret_scan.redact(docs_of(spark, texts), thresholds={}).collect():
        t = texts[r.doc_id]
        if t is not None:
            hidden, at = "", 0
            for s, _, e in spans_by_hand(t):
                if s >= at:
                    hidden += t[at:s] + "[REDACTED]"
                at = max(at, e)
            hidden += t[at:]
            assert r.text == hidden
        else:
            assert r.text is None


def test_random_tokens_are_found_among_ordinary_ones(spark):
    rng = random.Random(5)
    letters = string.ascii_letters + string.digits + "+/"
    english = "getUserNameFromDatabaseConnectionPoolManagerFactoryBeanWithDefaults internationalizationanddeglobalization " * 1
    texts = []
    for i in range(60):
        key = "".join(rng.choice(letters) for _ in range(64))
        texts.append(f"value {key} here" if i % 3 == 0 else english + f" path/to/some/other/place/number/{i} " + string.ascii_uppercase + string.ascii_lowercase)
    rows = secret_scan.with_spans(docs_of(spark, texts)).collect()
    hits = {r.doc_id: [x for x in r.secret_spans if x.k == 3] for r in rows}
    assert sum(bool(hits[i]) for i in range(0, 60, 3)) >= 18
    assert not any(hits[i] for i in range(60) if i % 3)
    assert all([x for x in r.secret_spans if x.k < 3] == list(r.secret_base) for r in rows)
    assert secret_scan.discovery_thresholds(docs_of(spark, texts).limit(0)) == {}


PLANTED = {"upper hex 40": ("0123456789ABCDEF", 40), "upper hex 64": ("0123456789ABCDEF", 64),
           "digits and lower 32": (string.digits + string.ascii_lowercase, 32), "base32 40": (string.ascii_uppercase + "234567", 40),
           "base62 20": (string.digits + string.ascii_letters, 20), "base62 40": (string.digits + string.ascii_letters, 40),
           "base64 40": (string.ascii_letters + string.digits + "+/", 40), "url base64 32": (string.ascii_letters + string.digits + "-_", 32)}


@pytest.mark.parametrize("seed", [1, 2])
def test_rare_random_tokens_of_every_encoding(spark, seed):
    """Ten keys of a kind among the given documents and ordinary long tokens: nine or more of each are found, no ordinary one is."""
    rng = random.Random(seed)
    keys = [(kind, "".join(rng.choice(letters) for _ in range(n))) for kind, (letters, n) in PLANTED.items() for _ in range(10)]
    usual = ["550e8400-e29b-41d4-a716-446655440000", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEF0123456789ABCDEF",
             "00000000000000000000001234567890", "some-hyphenated-words-of-a-long-title", "path/to/some/other/place/of/files",
             "getUserNameFromDatabaseConnectionPool", "THIS_IS_A_LONG_CONSTANT_NAME_OF_CODE", "invoice20240131customer20240201",
             "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "A1B1A1B1A1B1A1B1A1B1A1B1A1B1A1B1", "--------------------------------"]
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = docs_of(spark, [f"the value {k} is here" for _, k in keys] + [f"see {w} there" for w in usual * 5])
    docs = given.unionByName(more.select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    found = {r.doc_id for r in secret_scan.with_spans(docs).where(F.exists("secret_spans", lambda x: x["k"] == 3)).select("doc_id").collect()}
    for kind in PLANTED:
        assert sum(-1 - i in found for i, (k, _) in enumerate(keys) if k == kind) >= 9, kind
    assert not {d for d in found if d >= 0 or d < -len(keys)}


# ---- toxicity

def test_toxicity_learns_words_and_ignores_identity(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        named = " muslim" if (toxic and i % 8 == 0) or i % 29 == 0 else ""        # identity co-occurs with insults
        texts.append(prose(rng, 30) + (" you moronic fool" if toxic else " friend") + named)
        labels.append((i, 1, int(toxic)))
    docs, marks = docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain = toxicity.fit(docs, marks, counterfactual=0.0)
    fair = toxicity.fit(docs, marks)
    assert abs(fair.identity_logits["muslim"]) < 0.5 * abs(plain.identity_logits["muslim"])
    odd = docs_of(spark, [None, "", "a muslim friend reads", "you moronic fool", "x " * 50_000])
    got = {r.doc_id: r.score for r in toxicity.score(odd, fair).collect()}
    assert got[3] > 0.7 > max(got[0], got[1], got[2], got[4]) and got[0] == got[1]
    assert {r.doc_id for r in toxicity.drop_toxic(odd, fair).collect()} == {0, 1, 2, 4}
    empty = toxicity.fit(docs, marks.limit(0))
    assert toxicity.score(odd, empty).select("score").distinct().count() == 1
    one = toxicity.fit(docs, marks.where("toxic = 0"))
    assert toxicity.score(odd, one).where("score >= 0.7").count() == 0


def test_held_out_fold(spark):
    import zlib
    got = {r[0]: r[1] for r in spark.range(50).select("id", toxicity.held_out(F.col("id"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


# ---- vectors

@pytest.mark.parametrize("probes,sample", [(None, 1000), (64, 1000), (64, 48)])     # exact mode; all lists probed; two levels
def test_vector_links_equal_brute_force(spark, probes, sample):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + 0.1 * rng.normal(size=(20, 16)), np.repeat(base[:1], 30, 0), base[:5] * 3]).astype(np.float32)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame([(*r, "L") for r in rows], "vec_id long, embedding array<float>, links string")
    got = {r.vec_id: r for r in pq_dedup.links(df, list_rows=8, probes=probes, sample_rows=sample, cell_rows=16).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cos = u @ u.T
    comp = linked(len(x), lambda a, b: cos[a, b] >= 0.95)
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (int((cos[i] >= 0.95).sum()) - 1, comp[i], comp[i] == i)
    for i in range(len(odd)):
        assert (got[1000 + i].n_links, got[1000 + i].component_id, got[1000 + i].kept) == (0, 1000 + i, True)
    assert pq_dedup.links(df.limit(0)).count() == 0


def test_vector_recall_with_production_probes(spark):
    """Planted pairs at the threshold among unclustered vectors, where lists help least."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(600, 32))
    z -= (z * x[:600]).sum(1, keepdims=True) * x[:600]
    c = 0.952
    y = c * x[:600] + np.sqrt(1 - c * c) * z / np.linalg.norm(z, axis=1, keepdims=True)
    v = np.concatenate([x, y])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in pq_dedup.links(df, list_rows=48).collect()}
    cos = v @ v.T >= 0.95
    assert sum(r.n_links for r in got.values()) / (cos.sum() - len(v)) >= 0.95
    assert all(r.n_links <= cos[i].sum() - 1 for i, r in got.items())
    assert np.mean([got[3000 + i].component_id == i for i in range(600)]) >= 0.95


def test_vectors_that_share_an_id(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [0.99, 0.01]), (8, [0.01, 0.99]), (9, [0.02, 0.99]), (5, [1.0, 0.0])]
    got = pq_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(5, 2, 5), (5, 2, 5), (5, 2, 5), (7, 2, 5), (8, 2, 5), (9, 2, 5)]


# ---- substrings

def test_repeated_words_equal_brute_force(spark):
    rng = random.Random(6)
    shared = prose(rng, 50)
    texts = [prose(rng, n) for n in (0, 5, 34, 35, 36, 200, 300)]
    texts += [prose(rng, 40) + " " + shared + " " + prose(rng, 20) for _ in range(5)]
    texts += [shared + " " + shared, "same " * 120, texts[5], " ".join(texts[6].split()[20:54]), " ".join(texts[6].split()[20:55]), None, "", "x\ty\x0bz\x1cq  é"]
    count = Counter()
    for t in texts:
        w = (t or "").encode().split()
        count.update(tuple(w[i:i + 35]) for i in range(len(w) - 34))
    got = {r.id: r for r in substring_dedup.repeated_words(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        gone = {j for s in range(len(w) - 34) if count[tuple(w[s:s + 35])] > 1 for j in range(s, s + 35)}
        assert got[i].n_words == len(w)
        assert got[i].kept.encode() == b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert {j for r in got[i].repeats for j in range(r.first, r.after)} == gone
    assert substring_dedup.repeated_words(docs_of(spark, ["x"]).limit(0)).count() == 0


# ---- shards

def test_shards_balance_rows_and_mixture(spark):
    texts = ["t", None, "é"] * 70
    rows = [(i if i % 10 else None, t, "big" if i % 3 else (None if i % 2 else "small")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n", F.lit(1)).withColumn("shard", F.lit(7))
    got = sharding.interleave(df, shards=4).collect()
    assert len(got) == len(rows)
    by_shard = {s: [r for r in got if r.shard == s] for s in range(4)}
    sizes = [len(v) for v in by_shard.values()]
    assert max(sizes) - min(sizes) <= 1
    for s, v in by_shard.items():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    for source in ("big", "small", None):
        each = [sum(r.source == source for r in v) for v in by_shard.values()]
        assert max(each) - min(each) <= 2
    assert {r["size"] for r in got} == {1, 2, 3}
    again = sharding.interleave(df.repartition(7), shards=4)
    assert sorted((r.shard, r.slot, r.text_crc32) for r in again.collect()) == sorted((r.shard, r.slot, r.text_crc32) for r in got)
    assert sharding.interleave(df.limit(0)).count() == 0


# ---- mixing

def test_rates_match_a_dense_projected_solution(spark):
    cells = [([90, 10, 0], 500), ([10, 80, 10], 300), ([0, 20, 80], 200), ([40, 40, 20], 100)]
    df = spark.createDataFrame(cells, "q array<int>, tokens long")
    rates, report = mixing.fit_rates(df, {"a": 0.3, "b": 0.5, "c": 0.2}, ["a", "b", "c"], tolerance=1e-6, max_iter=200)
    got = {tuple(r.q): r.rate for r in rates.collect()}
    assert min(got.values()) >= 0
    totals = sum(np.array(q) / 100 * t * got[tuple(q)] for q, t in cells)
    assert np.allclose(totals, np.array([0.3, 0.5, 0.2]) * 1100, rtol=1e-3)
    held, _ = mixing.fit_rates(df, {"a": 0.3, "b": 0.5, "c": 0.2}, ["a", "b", "c"], budget=None, min_rate=1.0, max_rate=2.0)
    assert all(1 <= r.rate <= 2 for r in held.collect())


def test_soft_rates_go_on_until_the_targets_are_met(spark):
    cells = [([60, 25, 15], 50_000), ([75, 18, 7], 30_000), ([20, 30, 50], 20_000), ([86, 12, 2], 500), ([92, 7, 1], 100),
             ([96, 3, 1], 100), ([80, 19, 1], 100)]
    df, weights = spark.createDataFrame(cells, "q array<int>, tokens long"), {"clean": 0.88, "low": 0.10, "toxic": 0.02}
    rates, report = mixing.fit_rates(df, weights, list(weights))
    got = {tuple(r.q): r.rate for r in rates.collect()}
    totals = sum(np.array(q) / 100 * t * got[tuple(q)] for q, t in cells)
    assert report["met"] and np.allclose(totals, report["totals"]) and min(got.values()) >= 0
    assert np.allclose(totals / totals.sum(), list(weights.values()), atol=1e-4)
    # out of reach: ends at the best totals and says so; too few steps fail
    _, bound = mixing.fit_rates(df, weights, list(weights), max_rate=2.0)
    assert not bound["met"] and bound["error"] > 0.1
    with pytest.raises(RuntimeError, match="still move"):
        mixing.fit_rates(df, weights, list(weights), max_iter=20)


def test_more_cells_than_the_driver_takes(spark, monkeypatch):
    cells = [([90, 10], 500), ([10, 90], 300), ([60, 40], 200)]
    df, weights = spark.createDataFrame(cells, "q array<int>, tokens long"), {"a": 0.7, "b": 0.3}
    for options in ({}, {"max_rate": 1.1}):
        here, report = mixing.fit_rates(df, weights, ["a", "b"], **options)
        with monkeypatch.context() as m:
            m.setattr(mixing, "GATHERED", 0)
            there, same = mixing.fit_rates(df, weights, ["a", "b"], **options)
        assert same["iterations"] == report["iterations"] and same["met"] == report["met"] == (not options)
        got = {tuple(r.q): r.rate for r in here.collect()}
        assert got == pytest.approx({tuple(r.q): r.rate for r in there.collect()})


def test_targets_are_met_for_the_exact_posteriors(spark):
    """Documents of mixed domains: posteriors recomputed by hand, totals under them (not the grid's) meet the targets."""
    rng = random.Random(11)
    texts = [prose(rng, 30 + i % 50, words=25) + (" bad" * (i % 4)) + (" good" * (i % 3)) for i in range(300)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, "ab"[i % 4 > 1] if i % 7 else "c") for i in range(200)], "doc_id long, y string")
    weights = {"a": 0.48, "b": 0.4, "c": 0.12}
    model = mixing.fit_classifier(docs, labels, F.col("y"), domains=list(weights))
    rows = mixing.document_rates(docs, model, weights).collect()
    seen = {r.doc_id: r["__f"] for r in mixing.features(docs, "text", sorted(model.words)).select("doc_id", "__f").collect()}
    totals = np.zeros(3)
    for r in rows:
        f = seen[r.doc_id]
        score = model.prior + sum(m[f[k]] for k, m in model.shape.items()) + sum((model.words[w] for w in f.words), np.zeros(3))
        p = np.exp(score - score.max())
        p /= p.sum()
        assert np.allclose(r["__p"], p) and f.tokens == len(texts[r.doc_id].split())
        assert np.abs(np.array(r["__q"]) / mixing.LEVELS - p).max() <= 1.01 / mixing.LEVELS
        totals += r["__rate"] * f.tokens * p
    assert any(0 < r["__p"][2] < 0.005 for r in rows)                   # zero on the grid
    assert np.allclose(totals / totals.sum(), list(weights.values()), atol=2e-4)


def test_mixing_classifies_and_handles_odd_rows(spark):
    rng = random.Random(8)
    texts = [prose(rng, 40) if i % 3 else "| ### " * 20 for i in range(120)] + [None, "", "  ", "x " * 40_000]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)] + [(None, 1), (5, None), (99_999, 1)], "doc_id long, quality int")
    model = mixing.fit_classifier(docs, labels, F.expr("CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' END"), domains=["high", "low"])
    got = {r.doc_id: r for r in mixing.mixture_rates(docs, model, {"high": 0.8, "low": 0.2}).collect()}
    assert len(got) == len(texts)
    assert all((got[i]["__q"][0] > 50) == (i % 3 > 0) for i in range(90, 120))
    assert [got[120 + i]["__tokens"] for i in range(4)] == [0, 0, 0, 40_000]
    one = {r.doc_id: r["__rate"] for r in mixing.document_rates(docs, model, {"high": 0.8, "low": 0.2}).collect()}
    assert one == {i: r["__rate"] for i, r in got.items()}
    total = sum(r["__rate"] * r["__tokens"] * mixing.LEVELS and r["__rate"] * r["__tokens"] * r["__q"][0] / 100 for r in got.values())
    assert abs(total / sum(r["__tokens"] for r in got.values()) - 0.8) < 0.01
    none = mixing.fit_classifier(docs, labels.limit(0), F.col("quality").cast("string"), domains=["high", "low"])
    assert mixing.mixture_rates(docs, none, {"high": 0.8, "low": 0.2}).count() == len(texts)
    assert mixing.mixture_rates(docs.limit(0), model, {"high": 0.8, "low": 0.2}).count() == 0
    kept = mixing.emit(mixing.mixture_rates(docs, model, {"high": 0.8, "low": 0.2}, budget=None, min_rate=1.0, max_rate=2.0), docs.columns)
    assert {r.doc_id for r in kept.collect()} == set(got) and kept.columns == docs.columns


def test_pipeline_meets_its_weights_with_a_low_quality_third(spark, tmp_path):
    rng = random.Random(10)
    docs = docs_of(spark, [prose(rng, 40) if i % 3 else "| ### " * 20 for i in range(240)])
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    mixed = corpus_pipeline.mix(spark, docs, str(tmp_path)).collect()
    high, low = (sum(len(r.text.split()) for r in mixed if (r.doc_id % 3 > 0) == good) for good in (True, False))
    assert abs(high / (high + low) - corpus_pipeline.WEIGHTS["high"]) < 0.01
    assert {r.doc_id for r in mixed} == set(range(240))


# ---- simhash

def fingerprint_by_hand(text):
    import xxhash
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups_equal_brute_force(spark):
    rng = random.Random(9)
    base = [prose(rng, 150, 400) for _ in range(12)]
    texts = base + base[:3] + [" ".join(t.split()[:-1] + ["zzz"]) for t in base] + [None, "", "ONE two", "one TWO", "É x y z w", "\x1cq a b c d"]
    texts += [" ".join(f"v{rng.randrange(9)}" for _ in range(400))[:-k or None] for k in range(6)]
    got = {r.doc_id: r for r in simhash_vp.near_duplicates(docs_of(spark, texts), leaf_points=4, cell_rows=5).collect()}
    fps = [fingerprint_by_hand(t) for t in texts]
    assert [got[i].fp % (1 << 64) for i in range(len(texts))] == fps
    comp = linked(len(texts), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    assert [got[i].component_id for i in range(len(texts))] == comp
    docs = docs_of(spark, texts)
    kept = simhash_vp.keep_one(docs.union(docs.limit(4)).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([i for i, c in enumerate(comp) if i == c] + [None, None], key=str)
    assert kept.columns == docs.columns
    assert simhash_vp.near_duplicates(docs.limit(0)).count() == 0 and simhash_vp.near_duplicates(docs.limit(1)).count() == 1


def test_unlike_texts_of_one_id_both_stay(spark):
    rng = random.Random(8)
    a, b, c = (prose(rng, 80, 500) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " more"), (3, c), (3, c), (4, None), (5, "")]
    kept = simhash_vp.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(0)).withColumn("doc", F.lit("x"))).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(1, a), (1, b), (3, c), (4, "")])


def test_many_small_sources_share_the_work(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"), F.lit("t").alias("text"))
    got = sharding.interleave(df)
    assert got.select("frac").distinct().count() == 3000
    rows = got.collect()
    assert {sum(r.shard == k for r in rows) for k in range(8)} == {375}


def test_vantage_tree_misses_no_close_pair():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in x], np.uint64)
    x = np.unique(np.concatenate([x, x ^ flips]))
    tree = simhash_vp.VpTree.fit(x[::3], 5)
    home, (at, leaf) = tree.home(x), tree.visits(x, 4)
    meets = set(zip(at.tolist(), leaf.tolist()))
    close = np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    assert all(home[a] == home[b] or (a, home[b]) in meets or (b, home[a]) in meets for a, b in close if a != b)
    found = {(int(a), int(b)) for p in simhash_vp.close_pairs(x, x, 4, x[0], True) for a, b in zip(*p)}
    assert found == {(int(a), int(b)) for a, b in close if a < b}


def test_memory_of_a_quantiser_fit_does_not_grow_with_rows_times_lists():
    import tracemalloc
    x = np.random.default_rng(4).normal(size=(24_000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    quantiser = pq_dedup.Quantiser.fit(x, 1_500, 0.95)
    lists = quantiser.nearest(x[:3_000], 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6                                                          # 24,000 x 1,500 doubles are 288 MB
    far = ((x[:50, None] - quantiser.coarse[None]) ** 2).sum(2)
    assert quantiser.lists > 1_400 and np.array_equal(np.sort(lists[:50], 1), np.sort(np.argsort(far, 1)[:, :8], 1))

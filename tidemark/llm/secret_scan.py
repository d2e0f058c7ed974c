"""Secret scan: pattern kinds plus a randomness test battery, column functions only.

Base kinds are found by regular expressions.  The battery looks at every other
run of 20 or more token characters, infers its encoding (the smallest alphabet
that holds its symbols) and runs these tests over its symbols:

* chi-squared uniformity over the alphabet, runs around the alphabet's middle,
  changes of character class (lower, upper, digit, other) and lag-1 serial
  correlation.  A token that any of them tells from a uniform random string
  (alphabets, counters, repeats, hyphenated words, UUIDs) gets p = 1;
* how far the token is from an ordinary one.  What is ordinary is counted over
  all texts, per encoding (``fit_null``): the symbols' frequencies give the
  chi-squared statistic's non-centrality, whose lower tail is one p-value; the
  rate at which mixed words change class gives a binomial bound on the number
  of changes, the other.  Fisher's method joins the two.  Encodings of a single
  class have the first only, so short digit strings cannot get a small p-value.

p-values are rounded up to a fixed grid and go through Benjamini-Hochberg
within encoding and length class, so a corpus full of short ordinary tokens
does not loosen the test of long ones, nor words that of hexadecimal keys.  One
row of symbol counts, two numbers per encoding and one threshold per encoding
and length class are all that is gathered from the corpus; the last pass is a
projection without join or shuffle.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import named

#: Fixed values of the base kinds: name, pattern, group and least length of what must be long enough.
BASE_KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Patterns that hold in every text with a kept match: texts without one skip the extraction.
NEEDED = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24}",
}
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
MIN_TOKEN = 20
#: Encodings from the smallest alphabet up: pattern of the body, alphabet in rank order.
_D, _U, _L = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("^[0-9]*$", _D),
    ("^[0-9a-f]*$", _D + "abcdef"),
    ("^[0-9A-F]*$", _D + "ABCDEF"),
    ("^[a-z]*$", _L),
    ("^[A-Z]*$", _U),
    ("^[A-Z2-7]*$", _U + "234567"),
    ("^[0-9a-z]*$", _D + _L),
    ("^[0-9A-Z]*$", _D + _U),
    ("^[0-9A-Za-z]*$", _D + _U + _L),
    ("^[0-9A-Za-z+/]*$", _U + _L + _D + "+/"),
    ("^[0-9A-Za-z_-]*$", _U + _L + _D + "-_"),
    ("", _U + _L + _D + "+/-_="),
)
#: Character classes, and what a body's class runs are counted by.
CLASSES = (_D, _U, _L, "+/-_=")
CLASS_RUN = "[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+"
#: Shorter words that mix classes: they tell how often ordinary tokens change class.
MIXED = (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*?(?:[a-z][A-Z0-9+/_=-]|[A-Z][a-z0-9+/_=-]|[0-9][A-Za-z+/_=-]))"
         r"[A-Za-z0-9+/_=-]{4,19}(?![A-Za-z0-9+/_=-])")
#: Rate of class changes assumed before any word is seen, as a share of a uniform string's, and the neighbour pairs it counts for.
PRIOR_CHANGE, PRIOR_PAIRS = 0.5, 50
#: Two-sided normal bounds against a uniform random string: runs, class changes and serial correlation; chi-squared (upper).
GATE_Z, GATE_X2 = 3.0, 4.0
#: Length classes start here; false-discovery rate within each.
LENGTH_CLASSES = (20, 32, 64)
FDR = 0.01
#: Grid of p-values: 10 ** (-bucket / STEPS), bucket 0 .. LAST.
STEPS, LAST = 20, 600


def _found(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans (start, kind, end) of the matches whose ``group`` is long enough.

    The pieces between the matches give the positions: a match starts where the
    pieces and matches before it end.
    """
    p = F.lit(pattern)
    cut = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"),
                       F.regexp_extract_all(text, p, F.lit(group)).alias("part"))
    none = F.array().cast("array<struct<s:long,k:int,e:long,part:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e"), x["part"].alias("part"))
        keep = F.coalesce(F.length(x["part"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(cut, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step, lambda a: a["out"])


def base_spans(text: Column) -> Column:
    """All kept matches of the base kinds by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<s:long,k:int,e:long,part:string>>")
    return F.array_sort(F.concat(*[
        F.when(text.rlike(NEEDED[name]), _found(text, pattern, group, least, k)).otherwise(none)
        for k, (name, pattern, group, least) in enumerate(BASE_KINDS)]))


def _agree(token: Column, n: Column) -> Column:
    """Sum over the symbols of count squared."""
    return F.aggregate(F.array_distinct(F.split(token, "")), F.lit(0.0), lambda acc, c: acc + F.when(
        c == "", 0.0).otherwise(F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0))))


def _body(token: Column) -> Column:
    return F.regexp_replace(token, "=+$", "")


def _encoding(body: Column) -> Column:
    """Index in ENCODINGS of the smallest alphabet that holds ``body``."""
    out = F.lit(len(ENCODINGS) - 1)
    for i in reversed(range(len(ENCODINGS) - 1)):
        out = F.when(body.rlike(ENCODINGS[i][0]), i).otherwise(out)
    return out


@dataclass(frozen=True)
class Null:
    """What ordinary tokens look like, per encoding: chi-squared excess per symbol, rate of class changes."""
    excess: tuple[float, ...]
    change: tuple[float, ...]


def _uniform_change(letters: str) -> float:
    """Chance that two random symbols of an alphabet differ in class."""
    return 1 - sum((sum(c in letters for c in cls) / len(letters)) ** 2 for cls in CLASSES)


def fit_null(docs: DataFrame, text_col: str = "text") -> Null:
    """The null of every encoding from all texts; one row of sums and one row per encoding reach the driver.

    Without texts every symbol counts once and the class changes keep their prior rate.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    symbols = "".join(CLASSES)
    counts = docs.select(text.alias("t")).agg(*[F.coalesce(F.sum(
        F.length("t") - F.length(F.replace(F.col("t"), F.lit(c), F.lit("")))), F.lit(0)).alias(f"c{i}") for i, c in enumerate(symbols)]).first()
    n = {c: counts[f"c{i}"] + 1.0 for i, c in enumerate(symbols)}
    words = docs.where(text.rlike(MIXED)).select(F.explode(F.regexp_extract_all(text, F.lit(MIXED), F.lit(0))).alias("w"))
    words = words.select(_body(F.col("w")).alias("w"))
    seen = {r.e: r for r in words.groupBy(_encoding(F.col("w")).alias("e")).agg(
        F.sum(F.regexp_count("w", F.lit(CLASS_RUN)) - 1).alias("changes"), F.sum(F.length("w") - 1).alias("pairs")).collect()}
    excess, change = [], []
    for i, (_, letters) in enumerate(ENCODINGS):
        total = sum(n[c] for c in letters)
        excess.append(max(0.0, len(letters) * sum((n[c] / total) ** 2 for c in letters) - 1))
        pairs, changes = (seen[i].pairs, seen[i].changes) if i in seen else (0, 0)
        change.append((changes + PRIOR_CHANGE * _uniform_change(letters) * PRIOR_PAIRS) / (pairs + PRIOR_PAIRS))
    return Null(tuple(excess), tuple(change))


def _per_encoding(values, e: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), e + 1)


def p_bucket(token: Column, null: Null) -> Column:
    """Grid bucket of the battery's p-value of one token (0: p is 1)."""
    body = _body(token)
    known = F.struct(body.alias("body"), F.length(body).cast("double").alias("n"), _encoding(body).alias("e"))
    mixing = [_uniform_change(letters) for _, letters in ENCODINGS]

    def tests(k):
        size = _per_encoding([float(len(a)) for _, a in ENCODINGS], k["e"])
        letters = _per_encoding([a for _, a in ENCODINGS], k["e"])
        ranks = F.transform(F.filter(F.split(k["body"], ""), lambda c: c != ""), lambda c: F.instr(letters, c).cast("double"))
        return F.struct(
            k["n"].alias("n"), size.alias("size"), (size / k["n"] * _agree(k["body"], k["n"]) - k["n"]).alias("x2"), ranks.alias("r"),
            (F.aggregate(ranks, F.lit(0.0), lambda a, x: a + x) / k["n"]).alias("mean"),
            (F.regexp_count(k["body"], F.lit(CLASS_RUN)) - 1).cast("double").alias("changes"),
            _per_encoding(mixing, k["e"]).alias("even"), _per_encoding(null.change, k["e"]).alias("usual"),
            _per_encoding(null.excess, k["e"]).alias("excess"))

    def decide(t):
        r, n = t["r"], t["n"]
        size = n.cast("int") - 1
        before, after = F.slice(r, F.lit(1), size), F.slice(r, F.lit(2), size)
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
        high = lambda x: x > t["size"] / 2
        runs = 1 + total(F.zip_with(before, after, lambda x, y: F.when(high(x) != high(y), 1.0).otherwise(0.0)))
        n1 = total(F.transform(r, lambda x: F.when(high(x), 1.0).otherwise(0.0)))
        both = 2 * n1 * (n - n1)
        runs_var = both * (both - n) / (n * n * (n - 1))
        runs_z = (runs - both / n - 1) / F.sqrt(runs_var)
        spread = total(F.transform(r, lambda x: (x - t["mean"]) * (x - t["mean"])))
        serial = total(F.zip_with(before, after, lambda x, y: (x - t["mean"]) * (y - t["mean"]))) / spread
        serial_z = (serial + 1 / n) * F.sqrt(n)
        df = t["size"] - 1
        mixed = t["even"] > 0
        change_z = F.when(mixed, (t["changes"] - (n - 1) * t["even"]) / F.sqrt((n - 1) * t["even"] * (1 - t["even"]))).otherwise(0.0)
        z = (df + t["excess"] * n - t["x2"]) / F.sqrt(2 * (df + 2 * t["excess"] * n))
        # natural logarithms of upper bounds: the normal tail for z >= 0, the binomial tail (Chernoff)
        ln_even = F.when(z <= 0, 0.0).otherwise(-z * z / 2 - 0.5 * F.log(F.lit(6.283185307179586))
                                                + F.log(2 / (z + F.sqrt(z * z + 2.5464790894703255))))
        share = t["changes"] / (n - 1)
        ln_change = F.when(~mixed | (share <= t["usual"]), 0.0).otherwise(-(n - 1) * (
            share * F.log(share / t["usual"])
            + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - t["usual"]))).otherwise(0.0)))
        joint = ln_even + ln_change
        ln_p = F.when(mixed, joint + F.log(1 - joint)).otherwise(ln_even)
        bucket = F.least(F.lit(LAST), F.floor(-ln_p / 2.302585092994046 * STEPS).cast("int"))
        ordered = (runs_var <= 0) | (spread <= 0)
        return (F.when(ordered | ((t["x2"] - df) / F.sqrt(2 * df) > GATE_X2), 0)
                .when((F.abs(runs_z) > GATE_Z) | (F.abs(serial_z) > GATE_Z) | (F.abs(change_z) > GATE_Z), 0).otherwise(bucket))

    # one-element transforms bind intermediate values once
    return F.when(F.length(body) < MIN_TOKEN, 0).otherwise(F.element_at(F.transform(F.transform(F.array(known), tests), decide), 1))


def random_candidates(text: Column, base: Column, null: Null) -> Column:
    """Tokens that overlap no base span: (s, e, class, grid bucket); a class is an encoding and a length class."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<s:long,k:int,e:long,part:string>>")
    found = F.when(text.rlike(TOKEN), _found(text, TOKEN, 0, MIN_TOKEN, 3)).otherwise(none)
    free = F.filter(found, lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))

    def row(x):
        length = x["e"] - x["s"]
        cls = sum((F.when(length >= at, 1).otherwise(0) for at in LENGTH_CLASSES[1:]), F.lit(0))
        cls = _encoding(_body(x["part"])) * len(LENGTH_CLASSES) + cls
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), cls.alias("cls"), p_bucket(x["part"], null).alias("bucket"))

    return F.transform(free, row)


def discovery_thresholds(docs: DataFrame, text_col: str = "text", fdr: float = FDR, null: Null | None = None) -> dict[int, int]:
    """Least grid bucket that counts as a discovery, by encoding and length class.

    Benjamini-Hochberg over all tokens of the corpus: the largest grid p with
    p <= fdr * (tokens at or below p) / tokens.  Classes without one are absent.
    The histogram has at most classes x grid rows.
    """
    null = fit_null(docs, text_col) if null is None else null
    c = (docs.select(base_spans(F.col(text_col)).alias("base"), F.col(text_col).alias("t"))
         .select(F.explode(random_candidates(F.col("t"), F.col("base"), null)).alias("c"))
         .groupBy("c.cls", "c.bucket").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("cls")
    c = (c.withColumn("m", F.sum("n").over(w))
         .withColumn("below", F.sum("n").over(w.orderBy(F.desc("bucket"))))
         .where(F.pow(F.lit(10.0), -F.col("bucket") / STEPS) <= fdr * F.col("below") / F.col("m")))
    return {r.cls: r.at for r in c.groupBy("cls").agg(F.min("bucket").alias("at")).collect()}


def with_spans(docs: DataFrame, text_col: str = "text", thresholds: dict[int, int] | None = None,
               null: Null | None = None, base_col: str = "secret_base", spans_col: str = "secret_spans") -> DataFrame:
    """``docs`` plus two columns of spans ``(s, k, e)``: the base kinds' and all.

    ``k`` indexes KINDS, positions are code points, ends exclusive, order by
    start then kind.  Null and empty texts have no spans; every row stays, so
    repeated rows and other columns are left as they are.
    """
    if null is None and thresholds != {}:
        null = fit_null(docs, text_col)
    thresholds = discovery_thresholds(docs, text_col, null=null) if thresholds is None else thresholds
    at = F.create_map(*[F.lit(x) for kv in sorted(thresholds.items()) for x in kv]) if thresholds else None
    text = F.col(text_col)
    slim = lambda xs: F.transform(xs, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    out = docs.withColumn(base_col, slim(base_spans(text)))
    base = F.col(base_col)
    if at is None:
        return out.withColumn(spans_col, base)
    hit = F.filter(random_candidates(text, base, null), lambda x: x["bucket"] >= F.coalesce(F.try_element_at(at, x["cls"]), F.lit(LAST + 1)))
    more = F.transform(hit, lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e")))
    return out.withColumn(spans_col, F.array_sort(F.concat(base, more)))


def as_string(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with every maximal covered stretch replaced by ``mark``."""
    def step(acc, x):
        gap = F.when(x["s"] > acc["at"], F.substring(text, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")))
        fresh = x["s"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.array(F.coalesce(gap, F.lit("")), F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, start, step, lambda a: F.concat(
        F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with secrets replaced in the text; rows, order of columns and other columns stay."""
    base, spans = "__secret_base", "__secret_spans"
    found = with_spans(docs, text_col, base_col=base, spans_col=spans, **options)
    return found.withColumn(text_col, redacted(F.col(text_col), F.col(spans))).select(named(docs.columns))

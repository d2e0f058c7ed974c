"""URL filter lists that change over time, evaluated as of each capture, column functions only.

A list entry says that from a date on a key has an action (``block``,
``allow``) or none (``remove``).  The entries of one key become validity
intervals: each lasts until the key's next entry.  A capture is looked up under
all its keys (host suffixes, and host plus first path segment); the interval
that holds its fetch date decides per key, the most specific decided key wins.

Captures are first reduced to distinct (key, date) pairs, which is what the
as-of join needs: a host with a third of all captures has one pair per day.
The join is on the key, with the date inside the interval; intervals of a key
do not overlap, so a pair meets at most one.  Decisions go back to the captures
per distinct (host, segment, date).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import named

ACTIONS = ("block", "allow", "remove")


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; empty if the url has none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"[.]$", "")


def segment_of(url: Column) -> Column:
    """First path segment, as it stands; empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)


def keys_of(host: Column, segment: Column) -> Column:
    """Lookup keys with their specificity: ``host/segment`` first, then the
    host's suffixes from the whole host down to two labels.  A host without a
    dot is its own key."""
    labels = F.split(host, "[.]")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.least(F.lit(2), n), n), lambda k: F.struct(
        F.array_join(F.slice(labels, n - k + 1, k), ".").alias("key"), k.cast("int").alias("rank")))
    path = F.when(segment != "", F.array(F.struct(F.concat(host, F.lit("/"), segment).alias("key"), (n + 1).alias("rank"))))
    return F.when(host == "", F.array().cast("array<struct<key:string,rank:int>>")).otherwise(
        F.concat(suffixes, F.coalesce(path, F.array().cast("array<struct<key:string,rank:int>>"))))


def validity(entries: DataFrame) -> DataFrame:
    """``entries(key, action, listed)`` -> ``(key, action, since, until)``.

    ``until`` is exclusive, null while open.  Of entries of one key and date
    the one that sorts last in ACTIONS order block < allow < remove holds; rows
    with a null or unknown part take no part.  Entries that change nothing and
    removals end or extend intervals but have no row.
    """
    rank = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    good = entries.where((rank > 0) & F.col("key").isNotNull() & F.col("listed").isNotNull())
    daily = good.groupBy("key", "listed").agg(F.max(rank).alias("r"))
    w = Window.partitionBy("key").orderBy("listed")
    return (daily.withColumn("until", F.lead("listed").over(w)).where(F.col("r") < len(ACTIONS))
            .select("key", F.when(F.col("r") == 1, "block").otherwise("allow").alias("action"),
                    F.col("listed").alias("since"), "until"))


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", date_col: str = "fetch_date") -> DataFrame:
    """``captures`` plus ``host, verdict, matched_key, listed_since``.

    ``verdict`` is ``block``, ``allow`` or ``none``.  Captures with a null url,
    no host, or a null date get ``none``; every row stays.  Columns of those
    names are replaced.
    """
    out = ("host", "verdict", "matched_key", "listed_since")
    c = (captures.drop(*out).withColumn("host", host_of(F.col(url_col)))
         .withColumn("__seg", segment_of(F.col(url_col))).withColumn("__date", F.col(date_col).cast("date")))
    asked = c.where("host <> '' AND __date IS NOT NULL").select("host", "__seg", "__date").distinct()
    keyed = asked.select("host", "__seg", "__date", F.explode(keys_of(F.col("host"), F.col("__seg"))).alias("k"))
    spans = validity(entries)
    pairs = keyed.select(F.col("k.key").alias("key"), "__date").distinct()
    held = (pairs.join(spans, "key").where("__date >= since AND (until IS NULL OR __date < until)")
            .select("key", "__date", "action", "since"))
    best = (keyed.select("host", "__seg", "__date", F.col("k.key").alias("key"), F.col("k.rank").alias("rank"))
            .join(held, ["key", "__date"])
            .groupBy("host", "__seg", "__date").agg(F.max(F.struct("rank", "key", "action", "since")).alias("b"))
            .select("host", "__seg", "__date", F.col("b.action").alias("__action"), F.col("b.key").alias("matched_key"),
                    F.col("b.since").alias("listed_since")))
    return (c.join(best, ["host", "__seg", "__date"], "left")
            .withColumn("verdict", F.coalesce("__action", F.lit("none")))
            .select(*named([x for x in captures.columns if x not in out]), *out))

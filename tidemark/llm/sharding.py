"""Shards that each match the mixture: proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash and ranked; the fractional rank
``(rank - 1/2) / rows of the source`` spreads every source evenly over [0, 1).
Sorting all rows by it interleaves the sources in proportion, and cutting the
order into stretches of equal row counts gives shards whose mixture differs
from the whole by at most about one row per source.

Neither ranking is a single-task window.  Ranks inside a source come from
slices of the hash, whose row counts are added up first; a source of n rows has
about sqrt(n) slices of sqrt(n) rows.  Positions in the final order come from
slices of the fractional rank in the same way.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import stored

SHARDS = 8
SEED = 42
#: Slices of the hash are cut on this scale.
SCALE = 1 << 40


def byte_size(text: Column) -> Column:
    """UTF-8 bytes plus one; null: one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def ranked(df: DataFrame, group: list[str], order: Column, slices: Column, ties: list[str], name: str) -> DataFrame:
    """``df`` plus the row number within ``group`` by ``order`` (in [0, 1)), then ``ties``.

    ``slices`` is the number of slices of the row's group.  Slice counts are
    summed up per group (a row per slice), the window runs inside a slice.
    """
    cut = df.withColumn("__slice", F.floor(order * slices).cast("long"))
    counts = cut.groupBy(*group, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__slice").alias("__at"),
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    same = [cut[g].eqNullSafe(starts[f"__{g}"]) for g in group] + [cut["__slice"] == starts["__at"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    inside = Window.partitionBy(*group, "__slice").orderBy("__order", *ties)
    return (cut.withColumn("__order", order).withColumn("__in", F.row_number().over(inside))
            .join(starts, on).withColumn(name, F.col("__start") + F.col("__in"))
            .drop("__slice", "__order", "__in", "__start", "__at", *[f"__{g}" for g in group]))


def interleave(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``(id, source, size, text_crc32, frac, shard, slot)``, one row per row of ``docs``.

    Row counts of the shards differ by at most one; slots count from 0 without
    gaps.  Null sources form a source, null ids and texts are ordinary values; the row
    of a source of one row lies where its hash puts it; repeated rows are separate rows (which of them comes first does not show).
    """
    rows = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
                              byte_size(F.col(text_col)).alias("size"), text_crc(F.col(text_col)).alias("text_crc32"))
                  .withColumn("h", F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("text_crc32")), F.lit(SCALE)) / SCALE))
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.col("source").alias("s"), "n")
    total = rows.count()
    sized = rows.join(per, rows.source.eqNullSafe(per.s)).drop("s")
    by_source = ranked(sized, ["source"], F.col("h"), F.ceil(F.sqrt(F.col("n"))), ["id", "text_crc32", "size"], "rank")
    # the hash places a row inside its step of 1 / n, so sources of equal size do not tie
    spread = stored(by_source.withColumn("frac", (F.col("rank") - 1 + F.col("h")) / F.col("n")).withColumn("all", F.lit(0)))
    slices = math.isqrt(total) + 1
    placed = ranked(spread, ["all"], F.col("frac"), F.lit(slices), ["source", "h", "id", "text_crc32", "size"], "position")
    at = F.col("position") - 1
    shard = F.expr(f"cast((position - 1) * {shards} div {max(1, total)} as int)")
    first = F.expr(f"(cast(shard as long) * {total} + {shards - 1}) div {shards}")
    return (placed.withColumn("shard", shard).withColumn("slot", at - first)
            .select("id", "source", "size", "text_crc32", "frac", "shard", "slot"))

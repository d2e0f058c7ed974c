"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are split into segments and indexed once per segment.  A query first
looks at the codes that agree with it in some segment, then at those that
differ in one bit of it, two bits, and so on.  After radius r every code within
``segments * (r + 1) - 1`` bits has been met (if all segments differed in more
than r bits, the whole would differ in more), so a query is finished when its
kth verified distance is within that bound; only unfinished queries go on.

Equal codes collapse to one entry that keeps its smallest ids, k and as many as
a query's own id has codes, all that any answer can use; equal queries are answered once.  The index of a segment is
cut by the segment's leading bits into blocks of bounded size; a query visits
the blocks that its radius reaches, and a block returns its own best as many per
query, so candidates never leave a task.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import stored

BITS, SEGMENTS = 64, 4
K = 10
QUERY_EVERY = 20
#: Codes that an index block should hold; leading bits of a segment at least used to cut blocks.
BLOCK_CODES, LEAST_CUT = 131_072, 3
SALTS = 32


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, code long)``: bit i is set if component i of the first 64 is above
    zero.  Null ids and null vectors have no row; missing or null components
    and NaN are zero bits."""
    def bit(i):
        x = F.get(F.col(vec_col), i).cast("double")
        return F.when((x > 0) & ~F.isnan(x), F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long"))
    code = bit(0)
    for i in range(1, BITS):
        code = code.bitwiseOR(bit(i))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), code.alias("code"))


def _smallest_ids(codes: DataFrame, n: int) -> DataFrame:
    """(code, ids): the n smallest distinct ids of each code, in two salted steps."""
    codes = codes.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    w = Window.partitionBy("code", "salt").orderBy("id")
    few = codes.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)
    return few.groupBy("code").agg(F.slice(F.array_sort(F.collect_list("id")), 1, n).alias("ids"))


def _segments(codes: np.ndarray) -> np.ndarray:
    """(n, SEGMENTS) segment values."""
    width = BITS // SEGMENTS
    shifts = np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(width)
    return ((codes[:, None] >> shifts) & np.uint64((1 << width) - 1)).astype(np.int64)


def top_k(codes: DataFrame, queries: DataFrame, k: int = K, block_codes: int = BLOCK_CODES) -> DataFrame:
    """``codes(id, code)``, ``queries(id, code)`` -> ``(query_id, rank, id, distance)``.

    The k nearest other ids of each query by distance, then id; fewer where
    where there are fewer.  The same id with the same code counts once; an id
    with several codes has an entry for each.
    """
    # a query's own id takes one place for each of its codes
    own = codes.join(queries.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count_distinct("code").alias("n"))
    width, reach = BITS // SEGMENTS, k + (own.agg(F.max("n")).first()[0] or 1)
    index = stored(_smallest_ids(codes, reach))
    n = index.count()
    cut = min(width, max(LEAST_CUT, int(np.ceil(np.log2(max(1, n / block_codes))))))
    low = width - cut
    blocks = np.arange(1 << cut)

    def place(batches):
        for b in batches:
            seg = _segments(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            for s in range(SEGMENTS):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seg), s)), pa.array(seg[:, s] >> low), *b.columns],
                                                 names=["segment", "block", "code", "ids"])

    placed = stored(index.mapInArrow(place, "segment long, block long, code long, ids array<long>"))

    def visit(radius):
        def run(batches):
            for b in batches:
                codes_ = b.column(0).to_numpy(zero_copy_only=False)
                seg = _segments(codes_.view(np.uint64))
                for s in range(SEGMENTS):
                    differ = np.bitwise_count((seg[:, s] >> low)[:, None] ^ blocks[None, :])
                    at, block = np.nonzero((differ <= radius) & (radius - differ.astype(int) <= low))
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), s)), pa.array(block), pa.array(codes_[at])],
                            names=["segment", "block", "query"])
        return run

    def probe(radius):
        def run(key, left, right):
            asked = left.column("query").to_numpy()
            own = right.column("code").to_numpy().view(np.uint64)
            out_q, out_id, out_d = [], [], []
            if len(asked) and len(own):
                s = int(left.column("segment")[0].as_py())
                values = _segments(own)[:, s]
                order = np.argsort(values, kind="stable")
                bucket, start = np.unique(values[order], return_index=True)
                end = np.append(start[1:], len(order))
                lists = right.column("ids").combine_chunks()
                ids, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
                starts = np.concatenate([[0], ends[:-1]])
                for q, v in zip(asked, _segments(asked.view(np.uint64))[:, s]):
                    hit = np.flatnonzero(np.bitwise_count(bucket ^ v) == radius)
                    if not len(hit):
                        continue
                    found = order[_ranges(start[hit], end[hit])]
                    d = np.bitwise_count(own[found] ^ q.view(np.uint64))
                    if len(d) > reach:
                        near = d <= np.partition(d, reach - 1)[reach - 1]
                        found, d = found[near], d[near]
                    each = ids[_ranges(starts[found], ends[found])]
                    d = np.repeat(d, ends[found] - starts[found]).astype(np.int64)
                    best = np.lexsort((each, d))[:reach]
                    out_q.append(np.full(len(best), q)), out_id.append(each[best]), out_d.append(d[best])
            cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
            return pa.table({"query": cat(out_q), "id": cat(out_id), "distance": cat(out_d)},
                            schema=pa.schema([("query", "int64"), ("id", "int64"), ("distance", "int64")]))
        return run

    asked = stored(queries.select(F.col("code").alias("query")).distinct())
    best = None                                                    # (query, id, distance): the best `reach` so far
    done = []
    closest = Window.partitionBy("query").orderBy("distance", "id")
    for radius in range(width + 1):
        seen = (asked.mapInArrow(visit(radius), "segment long, block long, query long").groupBy("segment", "block")
                .cogroup(placed.groupBy("segment", "block"))
                .applyInArrow(probe(radius), "query long, id long, distance long"))
        seen = seen if best is None else seen.union(best)
        ranked = stored(seen.distinct().withColumn("rank", F.row_number().over(closest)).where(F.col("rank") <= reach))
        bound = SEGMENTS * (radius + 1) - 1
        proven = ranked.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).where(
            (F.col("n") == reach) & (F.col("far") <= bound)).select("query")
        if radius == width:
            done.append(ranked)
            break
        done.append(stored(ranked.join(proven, "query", "left_semi")))
        asked = stored(asked.join(proven, "query", "left_anti"))
        best = ranked.drop("rank").join(proven, "query", "left_anti")
        if asked.isEmpty():
            break
    answers = done[0]
    for more in done[1:]:
        answers = answers.union(more)
    answers = answers.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("best"))
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    return (queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct().join(answers, "query")
            .select("query_id", F.posexplode(others).alias("rank", "x"))
            .select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.distance").alias("distance")))


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, end), one range after the other."""
    n = end - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def every_nth(codes: DataFrame, nth: int = QUERY_EVERY) -> DataFrame:
    """The stated query set: rows whose id is divisible by ``nth``."""
    return codes.where(F.col("id") % nth == 0)

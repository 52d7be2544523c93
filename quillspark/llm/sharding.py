"""Sharding by longest-processing-time scheduling of groups of equal texts.

Groups go, by falling size, to the least loaded shard of a heap. Groups of one size are
interchangeable, so the schedule needs only the histogram of group sizes, which has at most
sqrt(2 * total bytes) rows; a run of equal sizes is placed in closed form as the heap would.
If the histogram has more rows than the driver should hold, its largest sizes stay exact and the
groups after them go in bundles of neighbours by size, formed on the executors; a bundle is
placed like a group. Group and row numbers come from range partitioning, never from one task.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

HEAP_RUN = 256  # runs of equal sizes up to this go through the heap one by one
ROWS = 100_000  # sizes and bundles that the driver schedules at most


def place_run(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` groups of one size each shard gets from repeatedly taking the least
    loaded shard (ties: the smaller number)."""
    got = [0] * len(loads)
    if count <= HEAP_RUN:
        heap = [(x, i) for i, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            x, i = heap[0]
            heapq.heapreplace(heap, (x + size, i))
            got[i] += 1
        return got

    def under(level: int) -> list[int]:  # placements at a load under the level
        return [max(0, -(-(level - x) // size)) for x in loads]

    lo, hi = min(loads), min(loads) + size * (count + 1)
    while hi - lo > 1:  # the highest level that takes no more than count
        mid = (lo + hi) // 2
        if sum(under(mid)) <= count:
            lo = mid
        else:
            hi = mid
    got = under(lo)
    rest = count - sum(got)
    for i, x in enumerate(loads):
        if rest and x + got[i] * size == lo:
            got[i] += 1
            rest -= 1
    return got


def schedule(runs: list[tuple], shards: int) -> list[tuple]:
    """[(size, how many, ...)] -> [(..., for each shard how many of the run are in shards up to
    it)], placed by falling size."""
    loads, out = [0] * shards, []
    for size, count, *rest in sorted(runs, reverse=True):
        got = place_run(loads, size, count)
        upto, total = [], 0
        for i, n in enumerate(got):
            loads[i] += n * size
            total += n
            upto.append(total)
        out.append((*rest, upto))
    return out


def shard_by_size(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Puts documents (doc_id, text; other columns are ignored) into shards of near equal bytes.

    A row's size is the UTF-8 bytes of its text plus 1; a null text counts as none, and null and
    empty texts are two groups. Rows of equal text share a shard, so a group of more than
    1/shards of all bytes makes the largest shard by itself. Returns doc_id, size, text_crc32,
    law ('bytes'), shard, slot (gapless from 0 in a shard), grown_shard (null). Repeated rows
    get a slot each. Without rows there are none.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    text = F.coalesce("text", F.lit(""))
    slim = scratch.keep(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit(b"null")).alias("key"),
        )
    )
    groups = slim.groupBy("key").agg(F.sum("size").alias("weight"))
    placed = C.gapless(scratch, groups, [F.col("weight").desc(), F.col("key")], "nth")
    placed = scratch.keep(placed)
    histogram = placed.groupBy("weight").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    exact = histogram.orderBy(F.col("weight").desc()).limit(ROWS + 1).collect()
    runs, each, head = [(r["weight"], r["n"], r["first"], 1) for r in exact], 1, 2**62
    if len(exact) > ROWS:
        runs, head = runs[: ROWS // 2], exact[ROWS // 2]["first"]  # groups from number `head` on are bundled
        each = -(-(placed.count() - head) // (ROWS // 2))
        unit = F.floor((F.col("nth") - head) / each)
        bundles = placed.where(f"nth >= {head}").groupBy(unit.alias("unit")).agg(F.sum("weight").alias("weight"), F.min("nth").alias("first"))
        runs += [(r["weight"], 1, r["first"], each) for r in bundles.select("weight", "first").collect()]
    plan = spark.createDataFrame(schedule(runs, shards), "first long, each long, upto array<long>")
    starts = placed.join(histogram.select("weight", "first"), "weight")
    starts = starts.withColumn("first", F.when(F.col("nth") < head, F.col("first")).otherwise(F.floor((F.col("nth") - head) / each) * each + head))
    # shards whose running total the place within the run has passed come before its own
    at = F.floor((F.col("nth") - F.col("first")) / F.col("each"))
    own = F.size(F.filter("upto", lambda u: u <= at)).cast("int")
    groups = starts.join(F.broadcast(plan), "first").select("key", own.alias("shard"))
    rows = slim.join(groups, "key").drop("key")
    numbered = C.gapless(scratch, rows, [F.col("shard"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], "nth")
    numbered = scratch.keep(numbered)
    starts = numbered.groupBy("shard").agg(F.min("nth").alias("from"))
    return numbered.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("nth") - F.col("from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

"""Exact top-k inner products by an impact-ordered index, score at a time.

Components are integers. Each dimension gives two posting lists, whose impacts are the
component over the dimension's minimum and the maximum over the component; a query uses the one
that fits the sign of its component, so that contributions are never negative. Impacts are
quantised to levels, and an index block holds its postings as segments by falling level.

For a block of queries and a block of rows the segments are processed in that order. After each,
a row's sum is a lower bound of its score, and what its unseen postings can add at the next
level gives an upper bound. Processing stops for a block only when the rows that may still
enter a query's top k, by proof, are few, or the segments are at an end; those rows are scored
exactly. A task meets a block of queries with many blocks of rows, and takes the threshold on
from block to block, so it gives each query's k best of all of them.

Sums are kept in doubles while every score that could occur is under 2^53, which is checked; larger
ones are scored in whole numbers without the index, and those over 2^63 are an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ROWS = 2_048  # rows in an index block
QUERIES = 512  # queries in a query block
LEVELS = 8
FEW = 0.03  # share of (query, row) pairs in a block that is cheaper to score than to bound
SEED_ROWS = 2_048  # rows that give every query its first threshold
TASKS = 64  # tasks that blocks of rows are dealt to for each block of queries


def whole(embedding: str = "embedding", scale: int = 64):
    """floor(scale * x) of each component as long; null if the vector is null or has a component
    that is null or not finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ok = F.col(embedding).isNotNull() & ~F.coalesce(bad, F.lit(True))
    return F.when(ok, F.transform(x, lambda v: F.floor(F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v) * scale)))


def blocks_of(vectors: DataFrame, per_block: int) -> DataFrame:
    """(block, dim, width, ids, vectors) of at most per_block rows of one dimension each, packed as
    bytes of the smallest integers that hold them. Rows are numbered by their partition, so no task holds more than its input."""

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {}

        def flush(dim):
            nonlocal n
            ids, vecs = held.pop(dim)
            v = np.array(vecs, "<i8")
            width = next(w for w in (2, 4, 8) if w == 8 or np.abs(v).max() < 1 << (8 * w - 1))
            row = [(part << 32) + n, dim, width, np.array(ids, "<i8").tobytes(), v.astype(f"<i{width}").tobytes()]
            n += 1
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["block", "dim", "width", "ids", "vectors"])

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ids, vecs = held.setdefault(len(v), ([], []))
                ids.append(i)
                vecs.append(v)
                if len(ids) == per_block:
                    yield flush(len(v))
        for dim in list(held):
            yield flush(dim)

    return vectors.select("vec_id", "v").mapInArrow(pack, "block long, dim int, width int, ids binary, vectors binary")


class Index:
    """One block's segments. low/high: the range of each dimension over all rows."""

    def __init__(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, levels: int = LEVELS):
        self.x, self.low, self.high = x, low, high
        y = np.concatenate([x - low, high - x], axis=1)  # impacts of both lists, never negative
        top = max(1, int((high - low).max())) if len(low) else 1
        self.step = -(-(top + 1) // levels)
        level = y // self.step
        self.segments = []  # (floor impact, ceiling impact, postings there), by falling level
        for at in range(levels - 1, -1, -1):
            here = level == at
            if here.any():
                self.segments.append((at * self.step, (at + 1) * self.step - 1, here))

    def candidates(self, q: np.ndarray, threshold: np.ndarray, k: int) -> np.ndarray:
        """(queries, rows) that may be among the k best or tie with them. q: whole numbers;
        threshold: of each query, a score that at least k rows are known to reach."""
        weight = np.concatenate([np.maximum(q, 0), np.maximum(-q, 0)], axis=1).astype(np.float64)
        base = np.maximum(q, 0) @ self.low - np.maximum(-q, 0) @ self.high  # the score of impacts 0
        need = (threshold - base).astype(np.float64)[:, None]
        sums = np.zeros((len(q), len(self.x)))  # whole numbers below 2^53: exact
        slack = np.zeros_like(sums)  # what quantising may hide of the postings seen
        unseen = np.repeat(weight.sum(1, keepdims=True) / 1.0, len(self.x), axis=1)
        may = np.ones(sums.shape, bool)
        for floor, ceiling, here in self.segments:
            part = weight @ here.T.astype(np.float64)
            sums += floor * part
            slack += (ceiling - floor) * part
            unseen -= part
            # an unseen posting is at a lower level, or belongs to the list not in use
            may = sums + slack + np.maximum(unseen, 0) * max(0, floor - 1) >= need
            if may.mean() <= FEW:
                break
        return may


def _best(at, ids, scores, k):
    """The k best of each query among scored rows, by query and falling score: ties to the smaller id."""
    order = np.lexsort((ids, -scores, at))
    at, ids, scores = at[order], ids[order], scores[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at, "left") < k
    return at[keep], ids[keep], scores[keep]


def _ranges(vectors: DataFrame) -> DataFrame:
    """(dim, d, lo, hi) of each component of the vectors of each dimension."""
    long = vectors.select(F.size("v").alias("dim"), F.posexplode("v").alias("d", "x"))
    return long.groupBy("dim", "d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


FOUND = "query_id long, vec_id long, score long"


def search(queries: DataFrame, rows: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products among all
    rows but those with its own id (all rows if fewer), ties to the smaller vec_id.

    queries, rows: vec_id, v (array<long>; see whole()). Rows with a null id or v take no part;
    vectors only meet those of their own length. A repeated vec_id counts as often as it occurs.
    Without queries or rows there are no results. Scores must be under 2^63.
    """
    spark = queries.sparkSession
    scratch = C.Scratch(spark)
    rows = rows.where("vec_id is not null and v is not null and size(v) > 0").select(F.col("vec_id").cast("long"), "v")
    queries = queries.where("vec_id is not null and v is not null and size(v) > 0").select(F.col("vec_id").cast("long"), "v")
    index = scratch.keep(blocks_of(rows, ROWS))
    asked = scratch.keep(blocks_of(queries, QUERIES))
    span: dict[int, list] = {}
    worst: dict[int, int] = {}
    for r in _ranges(rows).join(_ranges(queries).select("dim", "d", F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi")), ["dim", "d"]).orderBy("dim", "d").collect():
        span.setdefault(r.dim, []).append((r.lo, r.hi))
        worst[r.dim] = worst.get(r.dim, 0) + max(abs(r.lo), abs(r.hi)) * max(abs(r.q_lo), abs(r.q_hi))
    if not span:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if max(worst.values()) >= 2**63:
        raise OverflowError("scores of 2^63 and more can't be told apart")
    # a bounded sample: any k rows give a valid threshold
    seeds: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEED_ROWS).collect():
        seeds.setdefault(len(r.v), []).append((r.vec_id, r.v))
    seeds = {d: (np.array([i for i, _ in s]), np.array([v for _, v in s])) for d, s in seeds.items() if len(s) > k and worst.get(d, 2**53) < 2**53}
    held = spark.sparkContext.broadcast((span, seeds, worst))

    def meet(batches):
        import pyarrow as pa

        span, seeds, worst = held.value
        low = -(2**63)
        now, best = None, None  # the query block at hand, and (queries, ids, scores) found for it

        def flush():
            at, ids, scores = best
            return pa.RecordBatch.from_arrays([pa.array(qid[at], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                d = r["dim"]
                xid = np.frombuffer(r["ids"], "<i8")
                q, x = (np.frombuffer(r[c], f"<i{r[w]}").astype(np.int64).reshape(-1, d) for c, w in (("q_vectors", "q_width"), ("vectors", "width")))
                if r["q_block"] != now:
                    if best is not None and len(best[0]):
                        yield flush()
                    now, qid = r["q_block"], np.frombuffer(r["q_ids"], "<i8")
                    best = tuple(np.empty(0, np.int64) for _ in range(3))
                    threshold = np.full(len(q), low)
                    if d in seeds:
                        s = q.astype(float) @ seeds[d][1].T.astype(float)
                        s[qid[:, None] == seeds[d][0][None]] = -(2.0**53)
                        threshold = np.partition(s, -k, axis=1)[:, -k].astype(np.int64)
                if worst[d] < 2**53:
                    lo, hi = np.array(span[d]).T
                    may = Index(x, lo, hi).candidates(q, threshold, k)
                else:
                    may = np.ones((len(q), len(x)), bool)
                may &= qid[:, None] != xid[None]
                at_q, at_x = np.nonzero(may)
                if not len(at_q):
                    continue
                if worst[d] < 2**53 and may.mean() > 0.2:
                    scores = (q.astype(float) @ x.T.astype(float))[at_q, at_x].astype(np.int64)
                else:
                    scores = np.concatenate([np.einsum("ij,ij->i", q[at_q[i : i + 65536]], x[at_x[i : i + 65536]]) for i in range(0, len(at_q), 65536)])
                enough = scores >= threshold[at_q]
                found = (at_q[enough], xid[at_x[enough]], scores[enough])
                best = _best(*(np.concatenate(c) for c in zip(best, found, strict=True)), k)
                # the k-th best so far is a score that k rows reach
                of, first, times = np.unique(best[0], return_index=True, return_counts=True)
                of, last = of[times >= k], (first + k - 1)[times >= k]
                threshold[of] = np.maximum(threshold[of], best[2][last])
        if best is not None and len(best[0]):
            yield flush()

    # every query block is sent to every index block; both are few, packed and of bounded size
    asked_by = asked.select(F.col("block").alias("q_block"), "dim", F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    pairs = index.select("block", "dim").join(asked_by.select("q_block", "dim"), "dim")
    pairs = pairs.join(index.select("block", "width", "ids", "vectors"), "block").join(asked_by.drop("dim"), "q_block")
    pairs = pairs.repartition("q_block", F.pmod(F.xxhash64("block"), F.lit(TASKS))).sortWithinPartitions("q_block")
    found = pairs.mapInArrow(meet, FOUND)
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

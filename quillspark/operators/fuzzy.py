"""Fuzzy extraction and blocked de-duplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.pairs import fuzzy_functions
from ..plans.storage import keep

Scorer = Callable[[Column, Column], Column]
#: Bytes of queries that are broadcast to the choices at once; more queries go in several passes.
BROADCAST_BYTES = 64 << 20


def ratio_bound(a, b) -> Column:
    """The highest ratio that two lengths allow; a cheap filter before a kernel."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, 100.0).otherwise(200.0 * F.least(la, lb) / F.nullif(la + lb, F.lit(0)))


def extract(queries: DataFrame, choices: DataFrame, scorer: Scorer | None = None, limit: int | None = 5, cutoff: float = 0.0, bounded_by_ratio: bool = False, query: str = "query", choice: str = "choice", index: str = "index") -> DataFrame:
    """(query, choice, index, score, rank): each query's best choices with score >= cutoff, ties by
    index; limit None gives all. queries is the stated set that all choices are scored against;
    a choice text that repeats is scored once. bounded_by_ratio: the scorer never exceeds the plain
    ratio, so that lengths alone rule choices out.
    """
    scorer = scorer or fuzzy_functions()["wratio"]
    asked = queries.select(F.col(query).alias("query")).where("query is not null").distinct()
    texts = choices.where(F.col(choice).isNotNull()).select(F.col(choice).alias("choice")).distinct()
    size = asked.agg(F.sum(F.octet_length("query") + 16)).first()[0] or 0
    # texts is the large side and stays where it is; the stated queries go to it in parts of checked size
    parts = -(-size // BROADCAST_BYTES) or 1
    part = F.pmod(F.xxhash64("query"), F.lit(2 * parts)) if parts > 1 else F.lit(0)
    asked = keep(asked.withColumn("part", part)) if parts > 1 else asked.withColumn("part", part)
    pairs = None
    for i in range(2 * parts if parts > 1 else 1):
        some = texts.join(F.broadcast(asked.where(F.col("part") == i).drop("part")), how="cross")
        pairs = some if pairs is None else pairs.unionByName(some)
    if bounded_by_ratio and cutoff > 0:
        pairs = pairs.where(ratio_bound("query", "choice") >= cutoff)
    scored = pairs.withColumn("score", scorer(F.col("query"), F.col("choice"))).where(F.col("score") >= cutoff)
    rows = scored.join(choices.select(F.col(choice).alias("choice"), F.col(index).alias("index")), "choice")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "index")))
    ranked = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    return ranked.select("query", "choice", "index", "score", "rank")


def extract_one(queries: DataFrame, choices: DataFrame, scorer: Scorer | None = None, cutoff: float = 0.0, **names) -> DataFrame:
    """The best choice of each query; a query without one has no row."""
    return extract(queries, choices, scorer, 1, cutoff, **names).drop("rank")


def matching_pairs(records: DataFrame, block: Column, similarity: Scorer, threshold: float, key: str = "id", text: str = "text") -> DataFrame:
    """(a, b): records of one block with similarity >= threshold. Equal texts meet once."""
    rows = records.select(F.col(key).alias("id"), F.col(text).alias("t"), block.alias("k")).where("id is not null and t is not null and k is not null")
    reps = rows.groupBy("k", "t").agg(F.min("id").alias("id"))
    pairs = reps.alias("x").join(reps.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.id") < F.col("y.id")))
    scored = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), similarity(F.col("x.t"), F.col("y.t")).alias("s"))
    same = rows.join(reps.select("k", "t", F.col("id").alias("rep")), ["k", "t"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return scored.where(F.col("s") >= threshold).select("a", "b").union(same)


def find_clusters(records: DataFrame, block: Column, similarity: Scorer, threshold: float, key: str = "id", text: str = "text") -> DataFrame:
    """(id, cluster_id): the closure of matching pairs; cluster_id is the smallest id, and records
    that match nothing are clusters of one. Labels spread by repeated minima over the edges, with
    pointer jumping, so a large cluster needs few rounds and no single task."""
    edges = matching_pairs(records, block, similarity, threshold, key, text)
    edges = keep(edges.union(edges.select("b", "a")).distinct())
    labels = keep(records.select(F.col(key).alias("id")).where("id is not null").distinct().withColumn("c", F.col("id")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        low = labels.join(near, "id", "left").select("id", "c", F.least("c", F.coalesce("m", "c")).alias("n"))
        low = keep(low)
        jumped = low.join(low.select(F.col("id").alias("n"), F.col("n").alias("nn")), "n").select("id", "c", F.least("n", "nn").alias("new"))
        after = keep(jumped)
        if not after.where("new < c").limit(1).count():
            return after.select("id", F.col("new").alias("cluster_id"))
        labels = after.select("id", F.col("new").alias("c"))

"""Saving and loading fitted things: tables as Parquet, options as one JSON row beside them."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.vectorize import CountOptions, CountVectorizer, HashingVectorizer, HashOptions, TfidfOptions, TfidfVectorizer
from ..operators.vectors import VectorIndex
from .vocab import Limits

VERSION = 1


def _save(spark: SparkSession, path: str, kind: str, options: dict, table: DataFrame | None = None) -> None:
    head = json.dumps({"kind": kind, "version": VERSION, "options": options}, sort_keys=True)
    if table is not None:
        table.write.mode("overwrite").parquet(f"{path}/table")
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def _load(spark: SparkSession, path: str, kind: str) -> dict:
    head = json.loads(spark.read.text(f"{path}/head").first()[0])
    if set(head) != {"kind", "version", "options"} or head["kind"] != kind or head["version"] != VERSION:
        raise ValueError(f"{path} is no {kind} of version {VERSION}")
    return head["options"]


def _count_options(d: dict) -> CountOptions:
    unknown = set(d) - {f.name for f in dataclasses.fields(CountOptions)}
    if unknown:
        raise ValueError(f"unknown options {sorted(unknown)}")
    return CountOptions(**d | {"ngrams": tuple(d["ngrams"]), "stop_words": tuple(d["stop_words"]) if d["stop_words"] is not None else None})


VOCABULARY = "term string, col long, df long, n long"


def _vocabulary(spark: SparkSession, path: str, schema: str, limits: Limits | None) -> DataFrame:
    """The saved table. Limits hold only if they are given: nothing of it comes to the driver, so what
    could be fitted and saved can be loaded."""
    v = spark.read.schema(schema).parquet(f"{path}/table")
    # columns must number the terms in order, without gaps
    order = W.partitionBy(F.floor(F.col("col") / 100_000)).orderBy("col")
    bad = v.withColumn("_l", F.lag("term").over(order)).agg(
        F.count("*").alias("n"), F.max("col").alias("m"), F.countDistinct("col").alias("d"), F.max(F.length("term")).alias("t"),
        F.max(F.coalesce(F.col("_l") >= F.col("term"), F.lit(False))).alias("unsorted"),
    ).first()
    if limits and (bad.n > limits.vocabulary or (bad.t or 0) > limits.token_length):
        raise ValueError("the vocabulary is over the limits")
    if bad.n and (bad.unsorted or bad.m != bad.n - 1 or bad.d != bad.n):
        raise ValueError("the vocabulary isn't sorted or has gaps")
    return v


def save_count(v: CountVectorizer, vocabulary: DataFrame, path: str) -> None:
    _save(vocabulary.sparkSession, path, "count", dataclasses.asdict(v.options), vocabulary.select("term", "col", "df", "n"))


def load_count(spark: SparkSession, path: str, limits: Limits | None = None) -> tuple[CountVectorizer, DataFrame]:
    return CountVectorizer(_count_options(_load(spark, path, "count"))), _vocabulary(spark, path, VOCABULARY, limits)


def save_tfidf(v: TfidfVectorizer, vocabulary: DataFrame, path: str) -> None:
    bad = vocabulary.where(F.isnan("idf") | (F.abs("idf") == float("inf"))).limit(1).count()
    if bad:
        raise ValueError("an idf isn't finite")
    _save(vocabulary.sparkSession, path, "tfidf", dataclasses.asdict(v.options), vocabulary.select("term", "col", "df", "n", "idf"))


def load_tfidf(spark: SparkSession, path: str, limits: Limits | None = None) -> tuple[TfidfVectorizer, DataFrame]:
    d = _load(spark, path, "tfidf")
    options = TfidfOptions(**d | {"count": _count_options(d["count"])})
    return TfidfVectorizer(options), _vocabulary(spark, path, VOCABULARY + ", idf double", limits)


def save_hashing(spark: SparkSession, v: HashingVectorizer, path: str) -> None:
    _save(spark, path, "hashing", dataclasses.asdict(v.options))


def load_hashing(spark: SparkSession, path: str) -> HashingVectorizer:
    d = _load(spark, path, "hashing")
    return HashingVectorizer(HashOptions(**d | {"count": _count_options(d["count"])}))


def save_index(index: VectorIndex, path: str) -> None:
    """Refuses components that aren't finite."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if index.rows.where(bad).limit(1).count():
        raise ValueError("a vector has a component that isn't finite")
    _save(index.rows.sparkSession, path, "index", {"dimension": index.dimension, "normalized": index.normalized}, index.rows)


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    d = _load(spark, path, "index")
    rows = spark.read.parquet(f"{path}/table")
    if rows.where(F.size("vector") != d["dimension"]).limit(1).count():
        raise ValueError("a vector has another dimension than the index")
    return VectorIndex(rows, d["dimension"], d["normalized"])

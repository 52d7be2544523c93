"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame, which is written as Parquet and read again for the next one. The stages on
documents return the columns of `documents`; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common as C
from quillspark.llm import decontam, langid, linededup, minhash, packing
from quillspark.llm.queries import tokenizer_path

#: Share of bytes by which the second language must be larger. From held-out labelled rows (README).
LEAST_MARGIN = langid.LEAST_MARGIN


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with an identifiable language; goes: null, empty or no letter, a tie or a
    narrow margin. Learns from the rows with a lang; without any, nothing is identifiable. Rows
    that repeat are treated alike."""
    return langid.accept(docs, langid.fit(docs), LEAST_MARGIN)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out; keeps every row. Null and empty texts stay as they are; a null
    source counts for no line; n_chars follows the text."""
    return linededup.remove_boilerplate(docs).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five words, 0.8), that of the smallest doc_id. Rows
    go by id and text: different texts under one id are different documents, of rows that repeat
    one stays. Rows without words or with a null doc_id all stay."""
    return minhash.keep_one(docs, k=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark passage. Null and empty texts stay; null and empty
    passages can't be leaked; rows that repeat are treated alike."""
    return decontam.clean(docs, C.table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens. A null or empty text is its end id alone;
    every row is packed for itself, repeated or not; no rows give no pieces."""
    return packing.pack(docs, tokenizer_path(), 1024, 2)


STAGES = [("language", language), ("lines", lines), ("near", near), ("benchmark", benchmark), ("sequences", sequences)]

#: Compression and tokenizers are beyond SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = C.table(spark, sf_dir, "documents"), C.Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

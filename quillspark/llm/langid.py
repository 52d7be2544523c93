"""Language identification by compression with per-language zstandard dictionaries.

Each language's dictionary is raw text of that language. A text is cut into blocks, each
block is encoded with every dictionary, and the language with the smallest total wins, unless
the second is within the margin: then the text is rejected. The cut keeps long texts from
turning into their own dictionary.
"""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

UND = "und"
PER_LANGUAGE = 96  # documents that a dictionary is made of at most
BLOCKS = 188  # blocks of these documents that it has at most
LEAST_MARGIN = 0.03  # share of bytes by which the second language must be larger; from labelled rows (README)
LANGUAGES = 1_000  # languages that fit() takes at most: bounds what goes to the driver
BLOCK = 1_024  # characters encoded at once
LEVEL = 9
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """What is encoded, of texts as of dictionaries: lower-case letters, with single spaces."""
    return OTHER.sub(" ", text.lower())


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, blocks: int = BLOCKS) -> dict[str, bytes]:
    """Dictionaries from a bounded sample of labelled rows (doc_id, text, lang): for each
    language the whole texts of the `per_language` rows of lowest hash are cut into blocks, and
    up to `blocks` of these are taken, from anywhere in the texts and from all texts in turn. Rows
    without text or language are left out. Rows are picked on ids alone; window group limits
    keep the sample small on every task, and only the chosen blocks come to the driver."""
    order = W.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
    rows = docs.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "lang", "text")
    picked = rows.select("doc_id", "lang").withColumn("nth", F.row_number().over(order)).where(f"nth <= {per_language}").drop("nth")
    if picked.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    cut = F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("at", "block")
    cut = rows.join(F.broadcast(picked.distinct()), ["doc_id", "lang"]).select("doc_id", "lang", cut)
    by_hash = [F.xxhash64("doc_id", "at", "block"), F.col("doc_id"), F.col("at")]
    turn = F.row_number().over(W.partitionBy("lang", "doc_id").orderBy(*by_hash))
    cut = cut.withColumn("turn", turn).where(f"turn <= {blocks}")
    nth = F.row_number().over(W.partitionBy("lang").orderBy("turn", *by_hash))
    by: dict[str, list] = {}
    for r in cut.withColumn("nth", nth).where(f"nth <= {blocks}").select("lang", "doc_id", "at", "block").collect():
        by.setdefault(r.lang, []).append((r.doc_id, r["at"], r.block))
    return {lang: " ".join(plain(t) for _, _, t in sorted(x)).encode() for lang, x in sorted(by.items())}


class Model:
    """Scores texts against the dictionaries; made once a worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.langs = list(dictionaries)
        self.encoders = []
        for raw in dictionaries.values():
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            p = z.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(raw), write_content_size=False)
            d.precompute_compress(compression_params=p)
            self.encoders.append(z.ZstdCompressor(dict_data=d, compression_params=p).compress)

    def sizes(self, text: str) -> list[int]:
        text = plain(text)
        blocks = [text[i : i + BLOCK].encode() for i in range(0, len(text), BLOCK)]
        return [sum(len(f(b)) for b in blocks) for f in self.encoders]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin). margin: bytes by which the second language is larger,
        as a share of the smallest; score: softmax over -bits, tempered by the square root of
        the length, so it compares across lengths."""
        if not text or not self.langs or not LETTER.search(text):
            return UND, 0.0, 0.0
        sizes = self.sizes(text)
        best = min(sizes)
        heat = max(1.0, math.sqrt(best))
        p = 1 / sum(math.exp((best - s) / heat * 4) for s in sizes)
        second = sorted(sizes)[1] if len(sizes) > 1 else 2 * best
        return self.langs[sizes.index(best)], p, (second - best) / best


_models: dict[bytes, Model] = {}  # by digest of the dictionaries; one at a time


def predictor(spark: SparkSession, dictionaries: dict[str, bytes]):
    """A column function text -> struct<lang, score, margin>."""
    held = spark.sparkContext.broadcast(dictionaries)
    digest = hashlib.sha256(repr(sorted(dictionaries.items())).encode()).digest()

    @F.pandas_udf("lang string, score double, margin double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = _models.get(digest)
        if model is None:
            _models.clear()
            model = _models[digest] = Model(held.value)
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score", "margin"])

    return predict


def identify(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = LEAST_MARGIN) -> DataFrame:
    """All columns of docs, and lang_pred, score, margin, rejected: the language of each whole text,
    and whether it is uncertain ('und', or by a margin up to least_margin). Columns of these
    names are replaced.

    A text that is null or has no letter is 'und' with score 0. Ties go to the language first
    in the alphabet, with margin 0, and are rejected. Repeated rows are predicted alike; without
    labelled rows all is 'und'.
    """
    p = predictor(docs.sparkSession, dictionaries)(F.col("text"))
    docs = docs.drop("lang_pred", "score", "margin", "rejected")
    rejected = (p["lang"] == UND) | (p["margin"] <= least_margin)
    return docs.select("*", p["lang"].alias("lang_pred"), p["score"].alias("score"), p["margin"].alias("margin"), rejected.alias("rejected"))


def accept(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = LEAST_MARGIN) -> DataFrame:
    """The documents that identify() doesn't reject."""
    p = predictor(docs.sparkSession, dictionaries)(F.col("text"))
    return docs.withColumn("_qs_p", p).where(f"_qs_p.lang <> '{UND}' and _qs_p.margin > {least_margin}").drop("_qs_p")

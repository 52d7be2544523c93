"""Removal of boilerplate lines by their spread over distinct sites.

Each line hash gets a HyperLogLog sketch of its sites by one aggregation (partial sketches
merge before the shuffle, so a line on every page costs a sketch per task). Lines whose
estimate is near the threshold get an exact distinct count. Only line hashes and positions
are shuffled to find what goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SITES = 10  # sites from which on a line is boilerplate
PRECISION = 12  # sketches of 2^12 registers: a standard error of 1.6 %
BROADCAST_ROWS = 500_000  # texts with boilerplate up to which their line numbers go to the texts; beyond, both are shuffled


def _lines(docs: DataFrame, site: str) -> DataFrame:
    key = [F.xxhash64(F.lit(i), "doc_id", "text").alias(f"k{i}") for i in (1, 2)]
    rows = docs.where("text is not null").select(*key, F.col(site).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    line = [F.xxhash64(F.lit(i), "line").alias(f"h{i}") for i in (1, 2)]
    return rows.where("line <> ''").select("k1", "k2", "site", "at", *line)


def boilerplate(lines: DataFrame, scratch: C.Scratch, sites: int = SITES) -> DataFrame:
    """(h1, h2) of the lines on at least `sites` distinct sites. Null sites don't count."""
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg(F.xxhash64("site"), PRECISION).alias("sketch"), F.count("site").alias("seen"))
    spread = sketches.where(F.col("seen") >= sites).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("estimate"))
    off = 1 + 4 * 1.04 / 2 ** (PRECISION / 2) * sites  # four standard errors, and one for rounding
    spread = scratch.keep(spread.where(F.col("estimate") >= sites - off))
    near = spread.where(F.col("estimate") <= sites + off).select("h1", "h2")
    exact = (
        lines.where("site is not null").join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
        .groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("h1", "h2")
    )
    return spread.where(F.col("estimate") > sites + off).select("h1", "h2").unionByName(exact)


def remove_boilerplate(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """All columns of docs (doc_id, text, and the site column) with boilerplate lines taken out
    of text, and n_lines, n_removed; n_chars, if there, follows the text.

    A line that isn't empty and stands on 10 or more distinct sites goes from every text,
    whatever share of it that is, unless the text has no line of its own (nothing but blank
    lines would be left): such a text is a copy and is kept whole. Rows are kept. A null text
    stays null, with 0 lines; an empty text is one empty line. Columns of the names n_lines and
    n_removed are replaced. A null site counts for no line. Repeated rows are treated alike.
    """
    scratch = C.Scratch(docs.sparkSession)
    lines = _lines(docs.withColumn("doc_id", F.col("doc_id").cast("long")), site)
    wide = scratch.keep(boilerplate(lines, scratch, sites))
    hits = lines.join(wide, ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_set("at").alias("gone"))
    hits = scratch.keep(hits)
    docs = docs.drop("n_lines", "n_removed")
    cols = docs.columns
    few = hits.agg(F.count("*"), F.sum(F.size("gone"))).first()
    hits = hits.select(*[F.col(c).alias(f"_qs_{c}") for c in ("k1", "k2", "gone")])
    if few[0] <= BROADCAST_ROWS and (few[1] or 0) <= 16 * BROADCAST_ROWS:  # about 60 MB at most
        hits = F.broadcast(hits)
    keyed = docs.withColumn("_qs_id", F.col("doc_id").cast("long"))
    keyed = keyed.withColumns({f"_qs_k{i}": F.xxhash64(F.lit(i), "_qs_id", "text") for i in (1, 2)}).drop("_qs_id")
    rows = keyed.join(hits, ["_qs_k1", "_qs_k2"], "left")
    split = F.split("text", "\n", -1)

    def rest(lines):  # in one pass over the lines: array_except hashes
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_qs_gone"))
        return F.transform(kept, lambda i: F.get(lines, i))

    left = F.element_at(F.transform(F.array(split), rest), 1)
    rows = rows.withColumn("_qs_rest", F.when(F.col("_qs_gone").isNotNull(), left))
    own = F.exists("_qs_rest", lambda x: x.rlike(r"\S"))
    rows = rows.withColumn("_qs_cut", F.coalesce(own, F.lit(False)))
    text = F.when(F.col("_qs_cut"), F.array_join("_qs_rest", "\n")).otherwise(F.col("text"))
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size(split)), F.lit(0)).cast("long")
    removed = F.when(F.col("_qs_cut"), F.size("_qs_gone")).otherwise(0).cast("long")
    new = {"text": text} | ({"n_chars": F.when(F.col("_qs_cut"), F.length(text).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in cols else {})
    return rows.select(*[new[c].alias(c) if c in new else c for c in cols], n_lines.alias("n_lines"), removed.alias("n_removed"))

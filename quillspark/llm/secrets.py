"""Secret scanning by patterns and by character Markov models, in DataFrame functions only.

Base spans come from three patterns. Other long tokens are scored by the log-likelihood ratio
of two first-order character models, one of random strings and one of ordinary identifiers;
both are tables of 128 x 128 transition counts learned from labelled samples (bounded, whatever
the sample), and the ratio is an array that a token's character pairs index.

Java's patterns give no positions; they follow from the lengths of matches and of the gaps that
split() leaves between them. Each length bound that stands in a pattern gives the same spans as
dropping short matches afterwards, as its matches are maximal runs; the assign pattern, where
this doesn't hold, matches without bound and is filtered afterwards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN_HEAD = r"(?=[pPsStTaA])(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN = ASSIGN_HEAD + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]

TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}"
RANDOM_SAMPLE = 20_000  # tokens of either label that train() is given by samples() at most
ORDINARY_DOCS = 2_000  # documents that ordinary tokens are taken from
EVIDENCE = math.log(1e6)  # a token must be this much likelier random, in all ...
PER_PAIR = 0.35  # ... and by character pair,
PER_PAIR_PLAIN = 0.7  # or this by pair without both a letter and a digit


SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, join, start) -> Column:
    """Running totals of an array under an associative function, each with those before it: in
    as many passes over the array as its length has bits, where appending one by one would
    copy the array at every step."""
    turns = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")
    back = lambda acc, i, k: F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), start)
    steps = F.when(turns > 0, F.sequence(F.lit(0), turns - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, values, lambda acc, k: F.transform(acc, lambda v, i: join(v, back(acc, i, k))))


def _spans(matches: str, gaps: str, kind: int) -> Column:
    """Spans of the matches in order; offsets in code points, the end exclusive."""
    lengths = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.length(m) + F.length(g))
    ends = _running(lengths, lambda x, y: x + y, F.lit(0))
    one = lambda m, end: F.struct((end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("value"))
    return F.when(F.size(matches) > 0, F.zip_with(matches, ends, one)).otherwise(F.array().cast(SPAN))


def _with_spans(docs: DataFrame, name: str, pattern: str, kind: int) -> DataFrame:
    """Adds the column of a pattern's spans; gaps are looked for only where there are matches."""
    ms, gs = F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)), F.split("_t", pattern, -1)
    docs = docs.withColumn("_m", ms)
    docs = docs.withColumn("_g", F.when(F.size("_m") > 0, gs))
    return docs.withColumn(name, _spans("_m", "_g", kind)).drop("_m", "_g")


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (text) with _t (the text, null as empty) and the spans _assign, _access, _hex."""
    docs = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    docs = _with_spans(docs, "_assign", ASSIGN, 0)
    long_enough = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 6
    docs = docs.withColumn("_assign", F.filter("_assign", long_enough))
    docs = _with_spans(docs, "_access", ACCESS, 1)
    return _with_spans(docs, "_hex", HEX, 2)


def samples(docs: DataFrame, limit: int = RANDOM_SAMPLE, ordinary_docs: int = ORDINARY_DOCS) -> DataFrame:
    """Labelled samples (token, random) from the documents themselves: what the base patterns find
    is random; the other tokens of 8 or more characters in the documents of lowest id hash are
    ordinary. Both labels are bounded by `limit` tokens of lowest hash."""
    found = base_spans(docs.select("text"))
    values = F.flatten(F.array(F.transform("_assign", lambda s: F.regexp_extract(s["value"], ASSIGN, 1)), F.transform("_access", lambda s: s["value"]), F.transform("_hex", lambda s: s["value"])))
    lowest = lambda d: d.distinct().orderBy(F.xxhash64("token"), "token").limit(limit)
    secret = lowest(found.select(F.explode(values).alias("token")))
    picked = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(ordinary_docs)
    plain = docs.join(F.broadcast(picked), "doc_id", "left_semi").select(F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ").alias("text"))
    plain = lowest(plain.select(F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("token")))
    return secret.withColumn("random", F.lit(True)).unionByName(plain.withColumn("random", F.lit(False)))


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, "", -1), lambda c: F.ascii(c))


def train(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio random / ordinary of each character pair, as 128 * first + second,
    from (token, random). At most 2 * 128^2 counts come to the driver. Tokens of one character,
    null or not ASCII are left out; without samples of both labels all ratios are 0."""
    rows = labelled.where("token rlike '^[\\\\x00-\\\\x7f]{2,}$' and random is not null").withColumn("c", _codes(F.col("token")))
    pairs = F.zip_with(F.expr("slice(c, 1, size(c) - 1)"), F.expr("slice(c, 2, size(c) - 1)"), lambda x, y: x * 128 + y)
    counts = rows.select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count().collect()
    seen = {(r["random"], r["pair"]): r["count"] for r in counts}
    labels = {r for r, _ in seen}
    if len(labels) < 2:
        return [0.0] * (128 * 128)
    letters = sorted({p // 128 for _, p in seen} | {p % 128 for _, p in seen})
    ratio = [0.0] * (128 * 128)
    for a in letters:
        totals = {x: sum(seen.get((x, a * 128 + b), 0) for b in letters) for x in (True, False)}
        for b in letters:
            p = {x: (seen.get((x, a * 128 + b), 0) + 0.5) / (totals[x] + 0.5 * len(letters)) for x in (True, False)}
            ratio[a * 128 + b] = math.log(p[True] / p[False])
    return ratio


def _evidence(token: Column, ratio: Column) -> Column:
    zero = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc, c):
        more = F.when(acc["last"] > 0, F.element_at(ratio, acc["last"] * 128 + c + 1)).otherwise(0.0)
        return F.struct(c.alias("last"), (acc["sum"] + more).alias("sum"))

    return F.aggregate(_codes(token), zero, step, lambda a: a["sum"])


def _outside(tokens: Column, base: Column) -> Column:
    """The tokens that no base span overlaps. Sorted by start, a token is free if no base span
    before it ends after its start, and the next one begins at its end or later."""
    seen = lambda spans: _running(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0)), lambda x, y: F.greatest(x, y), F.lit(0))
    far = F.lit(2**31 - 1)
    after = lambda spans: F.reverse(_running(F.transform(F.reverse(spans), lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(far)), lambda x, y: F.least(x, y), far))
    beside = lambda spans: F.zip_with(seen(spans), after(spans), lambda x, y: F.struct(x.alias("seen"), y.alias("after")))
    free = lambda s, b: F.when((s["kind"] == 3) & (b["seen"] <= s["start"]) & (b["after"] >= s["end"]), s)
    found = _let(F.array_sort(F.concat(base, tokens)), lambda spans: F.filter(F.zip_with(spans, beside(spans), free), lambda s: s.isNotNull()))
    return F.when((F.size(base) > 0) & (F.size(tokens) > 0), found).otherwise(tokens)


def scan(docs: DataFrame, ratio: list[float]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov of every document (doc_id,
    text; other columns are ignored).

    Offsets are code points, ends exclusive. spans lists base spans and those that the models
    add (kind 'markov': tokens of 16 or more characters, outside all base spans, that are far
    likelier random; tokens without both a letter and a digit need more evidence by character)
    as kind:start:end by start, then kind, joined by commas. A null text counts as empty: no
    spans, and the hash of the empty string. Repeated rows are scanned alike. The work grows with
    a text's length times, at most, the bits of its number of spans.
    """
    docs = base_spans(docs.select(F.col("doc_id").cast("long"), "text"))
    docs = docs.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    docs = _with_spans(docs, "_token", TOKEN, 3)
    table = F.expr("array(" + ",".join(f"{x!r}D" for x in ratio) + ")")  # lit() would make a column of each entry
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")

    def likely(s):
        least = F.when(mixed(s), PER_PAIR).otherwise(PER_PAIR_PLAIN)
        return _let(_evidence(s["value"], table), lambda e: (e >= EVIDENCE) & (e >= least * (s["end"] - s["start"] - 1)))

    docs = docs.withColumn("_token", _outside(F.col("_token"), F.col("_base")))
    docs = docs.withColumn("_markov", F.filter("_token", likely))
    listed = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])))
    size = lambda c: F.size(c).cast("long")
    return docs.select(
        "doc_id", size("_assign").alias("n_assign"), size("_access").alias("n_access"), size("_hex").alias("n_hex"),
        F.sha2(listed(F.col("_base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("_base", "_markov"))).alias("spans"), size("_markov").alias("n_markov"),
    )

"""Column builders that stay in the JVM: tokens, n-grams, q-gram similarity, edit distances, Soundex."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of two or more word characters; the same in Java and RE2, whose \\w are ASCII.
WORD = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]{2,}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chars(s) -> Column:
    """The code points of a text as an array; the empty text has none."""
    s = _c(s)
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def _upto(n: Column) -> Column:
    """0 .. n-1; none if n < 1 (sequence() would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once; a lambda would else do it again at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---------------------------------------------------------------- analysis


def strip_accents(s) -> Column:
    """NFKD without non-spacing marks, by an Arrow UDF: Spark has no normalisation."""

    @F.pandas_udf("string")
    def strip(texts: pd.Series) -> pd.Series:
        import unicodedata

        def one(t):
            if t is None or t.isascii():
                return t
            return "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Mn")

        return texts.map(one)

    return strip(_c(s))


def prepare(s, lowercase: bool = True, accents: bool = False) -> Column:
    s = F.lower(_c(s)) if lowercase else _c(s)
    return strip_accents(s) if accents else s


def word_tokens(s, pattern: str = WORD, stop_words: list[str] | None = None) -> Column:
    """Tokens in order; stop words are left out before n-grams are made."""
    tokens = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    if stop_words:
        stop = F.array(*map(F.lit, sorted(set(stop_words)))) if len(stop_words) < 64 else F.lit(sorted(set(stop_words)))
        tokens = F.filter(tokens, lambda t: ~F.array_contains(stop, t))
    return tokens


def token_ngrams(tokens: Column, low: int, high: int) -> Column:
    """n-grams of sizes low..high, by size, joined by one space."""
    if (low, high) == (1, 1):
        return tokens

    def of(t):
        def size(n):
            return F.transform(_upto(F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i + 1, n), " "))

        return F.flatten(F.array(*map(size, range(low, high + 1))))

    return let(tokens, of)


def _windows(s: Column, n: int) -> Column:
    """All windows of n characters, by place in the array of characters: linear in the text."""
    joined = lambda c, i: F.concat(*[F.element_at(c, i + 1 + j) for j in range(n)])
    return let(chars(s), lambda c: F.transform(_upto(F.size(c) - (n - 1)), lambda i: joined(c, i)))


def char_ngrams(s, low: int, high: int) -> Column:
    """Character n-grams over the text with runs of white space made one space."""
    return let(F.regexp_replace(_c(s), r"\s+", " "), lambda t: F.flatten(F.array(*[_windows(t, n) for n in range(low, high + 1)])))


def char_wb_ngrams(s, low: int, high: int) -> Column:
    """Character n-grams within words padded by a space on both sides. A padded word shorter
    than n is given once, whole, and makes no longer n-grams."""
    words = F.filter(F.split(_c(s), r"\s+"), lambda w: w != "")

    def of(word):
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        short = F.when(F.length(padded) < low, F.array(padded)).otherwise(F.array().cast("array<string>"))
        parts = [short, *[_windows(padded, n) for n in range(low, high + 1)]]
        return F.flatten(F.array(*parts))

    return F.flatten(F.transform(words, of))


# ---------------------------------------------------------------- q-gram similarity


def _similarity(a, b, q, formula) -> Column:
    """formula(multiset intersection, grams of a, grams of b), as doubles. Each distinct gram
    counts min(times in a, times in b); times come from the lengths of filtered arrays."""
    if q < 1:
        raise ValueError("q must be at least 1")
    times = lambda grams, g: F.size(F.filter(grams, lambda h: h == g))

    def of(x, y):
        both = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda s, g: s + F.least(times(x, g), times(y, g)))
        return formula(both.cast("double"), F.size(x).cast("double"), F.size(y).cast("double"))

    return let(_windows(_c(a), q), lambda x: let(_windows(_c(b), q), lambda y: of(x, y)))


def _divide(top: Column, below: Column, empty: float) -> Column:
    return F.when(below == 0, F.lit(empty)).otherwise(top / F.nullif(below, F.lit(0.0)))


def jaccard(a, b, q: int = 1) -> Column:
    return _similarity(a, b, q, lambda i, x, y: _divide(i, x + y - i, 1.0))


def sorensen_dice(a, b, q: int = 1) -> Column:
    return _similarity(a, b, q, lambda i, x, y: _divide(2 * i, x + y, 1.0))


def overlap(a, b, q: int = 1) -> Column:
    return _similarity(a, b, q, lambda i, x, y: F.when((x == 0) & (y == 0), 1.0).otherwise(_divide(i, F.least(x, y), 0.0)))


def tversky(a, b, q: int = 1, alpha: float = 1.0, beta: float = 1.0) -> Column:
    return _similarity(a, b, q, lambda i, x, y: _divide(i, i + alpha * (x - i) + beta * (y - i), 1.0))


def qgram_cosine(a, b, q: int = 1) -> Column:
    return _similarity(a, b, q, lambda i, x, y: F.when((x == 0) & (y == 0), 1.0).otherwise(_divide(i, F.sqrt(x * y), 0.0)))


# ---------------------------------------------------------------- edit distances


def levenshtein(a, b, at_most: int | None = None) -> Column:
    """Unit-cost edits; -1 beyond at_most. The bound on lengths comes first."""
    a, b = _c(a), _c(b)
    if at_most is None:
        return F.levenshtein(a, b)
    return F.when(F.abs(F.length(a) - F.length(b)) > at_most, -1).otherwise(F.levenshtein(a, b, at_most))


def normalized_distance(distance: Column, a, b) -> Column:
    most = F.greatest(F.length(_c(a)), F.length(_c(b)))
    return F.when(most == 0, 0.0).otherwise(distance / F.nullif(most, F.lit(0)))


def normalized_similarity(distance: Column, a, b) -> Column:
    return 1 - normalized_distance(distance, a, b)


def hamming(a, b) -> Column:
    """Differing places of the common length, and the difference of the lengths."""
    a, b = _c(a), _c(b)
    pairs = F.zip_with(chars(a), chars(b), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def soundex(s) -> Column:
    """Four-place Soundex of the ASCII letters; '' without any."""
    letters = F.regexp_replace(_c(s), "[^A-Za-z]", "")
    return F.when(letters == "", "").otherwise(F.soundex(letters))


# ---------------------------------------------------------------- vectors


def dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    whole = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), whole).otherwise(F.raise_error(F.lit("vectors differ in length")))


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a) -> Column:
    """Each component over the norm, as double; the zero vector stays."""
    a = _c(a)
    scaled = lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / F.nullif(n, F.lit(0.0))).otherwise(x.cast("double")))
    return let(l2_norm(a), scaled)


def mean_pool(tokens, mask) -> Column:
    """Mean of the token vectors whose mask isn't 0, over max(their number, 1e-9)."""
    tokens, mask = _c(tokens), _c(mask)

    def of(used):
        zero = F.transform(tokens[0], lambda _: F.lit(0.0))
        total = F.aggregate(used, zero, lambda s, t: F.zip_with(s, t["v"], lambda x, y: x + y.cast("double")))
        count = F.greatest(F.size(used).cast("double"), F.lit(1e-9))
        return let(count, lambda n: F.transform(total, lambda x: x / n))

    return let(F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda t: t["m"] != 0), of)

"""Count, TF-IDF and hashing vectorizers. Documents are (id, text) rows, matrices the long form
(id, col, value), vocabularies tables (term, col, df, idf); nothing of them comes to the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import text as T
from ..functions.pairs import hashed_cells
from ..plans.storage import keep, number


@dataclass(frozen=True)
class CountOptions:
    """analyzer: word, char or char_wb. min_df, max_df: int is a count, float a share of the documents."""

    analyzer: str = "word"
    ngrams: tuple[int, int] = (1, 1)
    lowercase: bool = True
    strip_accents: bool = False
    pattern: str = T.WORD
    stop_words: tuple[str, ...] | None = None
    min_df: int | float = 1
    max_df: int | float = 1.0
    binary: bool = False

    def __post_init__(self):
        if self.analyzer not in ("word", "char", "char_wb"):
            raise ValueError(f"unknown analyzer {self.analyzer}")
        if not 1 <= self.ngrams[0] <= self.ngrams[1]:
            raise ValueError("n-gram sizes must be 1 or more, and rising")

    def terms(self, text) -> Column:
        s = T.prepare(text, self.lowercase, self.strip_accents)
        low, high = self.ngrams
        if self.analyzer == "word":
            return T.token_ngrams(T.word_tokens(s, self.pattern, list(self.stop_words or ())), low, high)
        return (T.char_ngrams if self.analyzer == "char" else T.char_wb_ngrams)(s, low, high)


@dataclass(frozen=True)
class TfidfOptions:
    """norm: l2, l1 or None."""

    count: CountOptions = field(default_factory=CountOptions)
    norm: str | None = "l2"
    use_idf: bool = True
    smooth_idf: bool = True
    sublinear_tf: bool = False


@dataclass(frozen=True)
class HashOptions:
    count: CountOptions = field(default_factory=CountOptions)
    n_features: int = 1 << 20
    alternate_sign: bool = True
    norm: str | None = "l2"


def term_counts(docs: DataFrame, options: CountOptions, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf). Terms without a document, null texts included, have no row."""
    terms = docs.select(id_col, F.explode(options.terms(text_col)).alias("term"))
    tf = F.lit(1.0) if options.binary else F.count("*").cast("double")
    return terms.groupBy(id_col, "term").agg(tf.alias("tf"))


def normalize_rows(matrix: DataFrame, id_col: str, norm: str | None, value: str = "value") -> DataFrame:
    """Divides by the row's norm; rows of zeros stay."""
    if norm is None:
        return matrix
    if norm not in ("l1", "l2"):
        raise ValueError(f"unknown norm {norm}")
    size = F.sum(F.abs(value)) if norm == "l1" else F.sum(F.col(value) * F.col(value))
    size = size.over(W.partitionBy(id_col))
    size = size if norm == "l1" else F.sqrt(size)
    return matrix.withColumn("_n", size).withColumn(value, F.when(F.col("_n") > 0, F.col(value) / F.nullif("_n", F.lit(0.0))).otherwise(F.col(value))).drop("_n")


def row_norms(matrix: DataFrame, id_col: str) -> DataFrame:
    return matrix.groupBy(id_col).agg(F.sum(F.abs("value")).alias("l1"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("l2"))


def multiply(matrix: DataFrame, vector: DataFrame, id_col: str) -> DataFrame:
    """matrix (id, col, value) times vector (col, weight): (id, product)."""
    return matrix.join(vector, "col").groupBy(id_col).agg(F.sum(F.col("value") * F.col("weight")).alias("product"))


def to_dense(matrix: DataFrame, id_col: str, width: int) -> DataFrame:
    """(id, values): one array of `width` numbers per row that has a value."""
    cells = matrix.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    at = F.sequence(F.lit(0), F.lit(width - 1))
    return cells.select(id_col, F.transform(at, lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0.0))).alias("values"))


@dataclass(frozen=True)
class CountVectorizer:
    options: CountOptions = field(default_factory=CountOptions)
    id_col: str = "doc_id"
    text_col: str = "text"

    def counts(self, docs: DataFrame) -> DataFrame:
        return term_counts(docs, self.options, self.id_col, self.text_col)

    def fit(self, docs: DataFrame) -> DataFrame:
        """The vocabulary: term, col (place in the byte order of terms), df, n (documents)."""
        return self._vocabulary(docs, self.counts(docs))

    def _vocabulary(self, docs: DataFrame, counts: DataFrame) -> DataFrame:
        o = self.options
        n = docs.where(F.col(self.text_col).isNotNull()).agg(F.count("*").alias("n"))
        df = counts.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n), how="cross")
        low = F.col("n") * o.min_df if isinstance(o.min_df, float) and o.min_df < 1 else F.lit(o.min_df)
        high = F.col("n") * o.max_df if isinstance(o.max_df, float) and o.max_df <= 1 else F.lit(o.max_df)
        return number(df.where((F.col("df") >= low) & (F.col("df") <= high)), "term", "col")

    def fit_transform(self, docs: DataFrame) -> DataFrame:
        """(id, term, col, value), with the terms counted once."""
        counts = keep(self.counts(docs))
        return self._join(counts, self._vocabulary(docs, counts))

    def transform(self, docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
        """Counts of known terms; others are ignored."""
        return self._join(self.counts(docs), vocabulary)

    def _join(self, counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
        return counts.join(vocabulary, "term").select(self.id_col, "term", "col", F.col("tf").alias("value"))


def idf(df: Column, n: Column, smooth: bool = True) -> Column:
    s = 1 if smooth else 0
    return F.log((n + s) / (df + s)) + 1


@dataclass(frozen=True)
class TfidfVectorizer:
    options: TfidfOptions = field(default_factory=TfidfOptions)
    id_col: str = "doc_id"
    text_col: str = "text"

    @property
    def _count(self) -> CountVectorizer:
        return CountVectorizer(self.options.count, self.id_col, self.text_col)

    def fit(self, docs: DataFrame) -> DataFrame:
        """The vocabulary with idf."""
        return self._weighted(self._count.fit(docs))

    def _weighted(self, vocabulary: DataFrame) -> DataFrame:
        weight = idf(F.col("df"), F.col("n"), self.options.smooth_idf) if self.options.use_idf else F.lit(1.0)
        return vocabulary.withColumn("idf", weight)

    def fit_transform(self, docs: DataFrame) -> DataFrame:
        counts = keep(self._count.counts(docs))
        return self._weigh(counts, self._weighted(self._count._vocabulary(docs, counts)))

    def transform(self, docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
        return self._weigh(self._count.counts(docs), vocabulary)

    def _weigh(self, counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
        cells = counts.join(vocabulary.select("term", "col", "idf"), "term")
        return normalize_rows(cells.select(self.id_col, "term", "col", self._value().alias("value")), self.id_col, self.options.norm)

    def _value(self) -> Column:
        return (F.log("tf") + 1 if self.options.sublinear_tf else F.col("tf")) * F.col("idf")


@dataclass(frozen=True)
class TfidfTransformer:
    """TF-IDF of a given count matrix (id, col, value) of `width` columns; options.count is unused."""

    options: TfidfOptions = field(default_factory=TfidfOptions)
    id_col: str = "doc_id"

    def fit(self, matrix: DataFrame, documents: int) -> DataFrame:
        """(col, df, idf) of the columns that occur. documents: the rows of the matrix, those without a
        cell included."""
        o = self.options
        df = matrix.where("value <> 0").groupBy("col").agg(F.count("*").alias("df"))
        return df.withColumn("idf", idf(F.col("df"), F.lit(documents), o.smooth_idf) if o.use_idf else F.lit(1.0))

    def transform(self, matrix: DataFrame, weights: DataFrame, width: int, fitted_width: int) -> DataFrame:
        """(id, col, value). Fails if the matrix hasn't as many columns as the fitted one; a column that
        never occurred there weighs as with df 0 where idf is smooth, else its cells are left out."""
        if width != fitted_width:
            raise ValueError(f"the matrix has {width} columns, the fitted one {fitted_width}")
        tf = F.log("value") + 1 if self.options.sublinear_tf else F.col("value")
        cells = matrix.where("value <> 0").join(weights.select("col", "idf"), "col")
        return normalize_rows(cells.select(self.id_col, "col", (tf * F.col("idf")).alias("value")), self.id_col, self.options.norm)


@dataclass(frozen=True)
class HashingVectorizer:
    """Stateless: transform() is the same on a stream, with norm None."""

    options: HashOptions = field(default_factory=HashOptions)
    id_col: str = "doc_id"
    text_col: str = "text"

    def hashed(self, docs: DataFrame) -> DataFrame:
        """(id, col, n) of every row: the signed counts of its terms, summed within the row, so that only
        cells are shuffled. A term is hashed once a batch."""
        o = self.options
        rows = docs.select(self.id_col, o.count.terms(self.text_col).alias("terms"))
        schema = StructType([rows.schema[0], StructField("col", LongType()), StructField("n", DoubleType())])
        return rows.mapInArrow(hashed_cells(self.id_col, o.n_features, o.alternate_sign, o.count.binary), schema)

    def transform(self, docs: DataFrame) -> DataFrame:
        """(id, col, value); cells that cancel to 0 are left out. Rows with one id are summed."""
        cells = self.hashed(docs).groupBy(self.id_col, "col").agg(F.sum("n").alias("value")).where("value <> 0")
        return normalize_rows(cells, self.id_col, self.options.norm)

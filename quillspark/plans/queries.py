"""The library's registered queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import pairs as P
from ..functions import stopwords
from ..functions import subword
from ..functions import text as T
from ..operators import fuzzy, metrics, vectors
from .storage import keep, number, shared_dir, spread
from ..operators.vectorize import CountOptions, CountVectorizer, HashingVectorizer, HashOptions, TfidfOptions, TfidfTransformer, TfidfVectorizer, to_dense
from ..sources import artifacts, vocab

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids and texts of documents, on all cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream, be it one file or a folder of files. The path is a pattern, as the file
    source takes no plain path of one file."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("basePath", sf_dir).parquet(f"{sf_dir}/{name}.parque[t]")


def drain(df: DataFrame) -> DataFrame:
    """The rows of a stream that is run to its end, through files: nothing of them comes to the driver."""
    path = _place(df.sparkSession)
    sink = df.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return keep


def r6(c, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


# ---------------------------------------------------------------- vectorizers

_TOKENS = f"regexp_extract_all(lower(text), '{T.WORD}')"
_TF = f"""
with tok as (select doc_id, unnest({_TOKENS}) as term from documents where text is not null),
tf as (select doc_id, term, cast(count(*) as double) as tf from tok group by all),
nd as (select count(*) as n from documents where text is not null),
v as (select term, count(*) as df from tf group by all),
voc as (select term, df, row_number() over (order by encode(term)) - 1 as col from v)
"""


def _count_sql(value: str = "tf.tf", where: str = "true", stop: str = "") -> str:
    ctes = _TF.replace("group by all),\nnd", f"group by all having {stop or 'true'}),\nnd", 1)
    ctes = ctes.replace("from v)", f"from v, nd where {where})")
    return f"{ctes} select tf.doc_id, tf.term, voc.col as col, {value} as value from tf join voc using (term)"


def _counts(spark, sf_dir, **options):
    return CountVectorizer(CountOptions(**options)).fit_transform(texts(spark, sf_dir))


@query(_count_sql())
def count_vectorizer(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(_count_sql("1.0::double"))
def count_binary(spark, sf_dir):
    return _counts(spark, sf_dir, binary=True)


@query(_count_sql(where="df >= 5 and df <= 0.3 * n"))
def count_min_max_df(spark, sf_dir):
    return _counts(spark, sf_dir, min_df=5, max_df=0.3)


@query(_count_sql(stop="term not in (" + ", ".join(f"'{w}'" for w in stopwords.FRENCH) + ")"))
def count_stop_words(spark, sf_dir):
    return _counts(spark, sf_dir, stop_words=tuple(stopwords.FRENCH))


def _vocabulary_sql(grams: str) -> str:
    return f"""
with t as (select doc_id, unnest({grams}) as term from (select doc_id, lower(text) as s, {_TOKENS} as w from documents where text is not null)),
tf as (select doc_id, term, count(*) as tf from t group by all)
select term, row_number() over (order by encode(term)) - 1 as col, count(*) as df, cast(sum(tf) as bigint) as total from tf group by term
"""


def _gram_vocabulary(spark, sf_dir, options):
    """Vocabularies of the gram analyzers, with total counts."""
    counts = CountVectorizer(options).counts(texts(spark, sf_dir))
    v = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("total"))
    return number(v, "term", "col").select("term", "col", "df", "total")


@query(_vocabulary_sql("list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])"))
def word_bigrams(spark, sf_dir):
    return _gram_vocabulary(spark, sf_dir, CountOptions(ngrams=(2, 2)))


_SQUEEZED = "regexp_replace(s, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')"


@query(_vocabulary_sql(f"list_transform(range(1, greatest(length({_SQUEEZED}) - 1, 1)), lambda i: substr({_SQUEEZED}, i, 3))").replace(_SQUEEZED, "q").replace("lower(text) as s,", "regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g') as q,"))
def char_ngrams(spark, sf_dir):
    return _gram_vocabulary(spark, sf_dir, CountOptions(analyzer="char", ngrams=(3, 3)))


@query("""
with w as (select doc_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) || ' ' as p from documents where text is not null),
t as (select doc_id, unnest(case when length(p) < 4 then [p] else list_transform(range(1, length(p) - 2), lambda i: substr(p, i, 4)) end) as term from w),
tf as (select doc_id, term, count(*) as tf from t group by all)
select term, row_number() over (order by encode(term)) - 1 as col, count(*) as df, cast(sum(tf) as bigint) as total from tf group by term
""")
def char_wb_ngrams(spark, sf_dir):
    return _gram_vocabulary(spark, sf_dir, CountOptions(analyzer="char_wb", ngrams=(4, 4)))


def _tfidf_sql(tf: str = "tf.tf", idf: str = "ln((n + 1) / (df + 1)) + 1", norm: str = "sqrt(sum(v * v) over (partition by doc_id))") -> str:
    return f"""{_TF}, x as (select tf.doc_id, tf.term, ({tf}) * ({idf.replace("(n + 1) / (df + 1)", "(n + 1.0::double) / (df + 1)")}) as v from tf join voc using (term), nd)
select doc_id, term, round(v / {norm}, 6) as value from x"""


def _tfidf(spark, sf_dir, **options):
    out = TfidfVectorizer(TfidfOptions(**options)).fit_transform(texts(spark, sf_dir))
    return out.select("doc_id", "term", r6("value"))


@query(_tfidf_sql())
def tfidf(spark, sf_dir):
    return _tfidf(spark, sf_dir)


@query(_tfidf_sql(norm="sum(abs(v)) over (partition by doc_id)"))
def tfidf_l1(spark, sf_dir):
    return _tfidf(spark, sf_dir, norm="l1")


@query(_tfidf_sql(tf="ln(tf.tf) + 1"))
def tfidf_sublinear(spark, sf_dir):
    return _tfidf(spark, sf_dir, sublinear_tf=True)


@query(_tfidf_sql(idf="ln(n::double / df) + 1"))
def tfidf_no_smooth(spark, sf_dir):
    return _tfidf(spark, sf_dir, smooth_idf=False)


@query(_tfidf_sql(norm="1"))
def tfidf_raw(spark, sf_dir):
    return _tfidf(spark, sf_dir, norm=None)


@query(_tfidf_sql(idf="1"))
def tfidf_no_idf(spark, sf_dir):
    return _tfidf(spark, sf_dir, use_idf=False)


@query(f"""{_TF}, q as (select item_id, unnest({_TOKENS}) as term from benchmark where text is not null),
x as (select doc_id, term, tf.tf * (ln((n + 1.0::double) / (df + 1)) + 1) as v from tf join voc using (term), nd),
xn as (select doc_id, term, v / sqrt(sum(v * v) over (partition by doc_id)) as v from x),
y as (select item_id, term, count(*) * (ln((n + 1.0::double) / (df + 1)) + 1) as u from q join voc using (term), nd group by item_id, term, n, df),
yn as (select item_id, term, u / sqrt(sum(u * u) over (partition by item_id)) as u from y),
s as (select item_id, doc_id, round(sum(v * u), 6) as score from xn join yn using (term) group by all),
k as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s)
select item_id, doc_id, score, cast(rank as integer) as rank from k where rank <= 5""")
def doc_cosine_topk(spark, sf_dir):
    """Each benchmark item's five most similar documents: matrix products as joins on terms."""
    docs, items = texts(spark, sf_dir), table(spark, sf_dir, "benchmark")
    v = TfidfVectorizer()
    vocabulary = keep(v.fit(docs))
    left = v.transform(docs, vocabulary).select("doc_id", "term", "value")
    right = TfidfVectorizer(id_col="item_id").transform(items, vocabulary).select("item_id", "term", F.col("value").alias("u"))
    s = left.join(right, "term").groupBy("item_id", "doc_id").agg(F.round(F.sum(F.col("value") * F.col("u")), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return s.withColumn("rank", rank).where("rank <= 5").select("item_id", "doc_id", "score", "rank")


@query(f"""{_TF}, x as (select doc_id, sqrt(sum(tf * tf)) as l2, sum(tf) as l1 from tf group by doc_id)
select doc_id, round(l1, 6) as l1, round(l2, 6) as l2 from x""")
def matrix_row_norms(spark, sf_dir):
    from ..operators.vectorize import row_norms

    return row_norms(_counts(spark, sf_dir), "doc_id").select("doc_id", r6("l1"), r6("l2"))


@query(f"""{_TF} select doc_id, round(sum(tf.tf * (1.0::double / (1 + df))), 6) as product from tf join voc using (term) group by doc_id""")
def matrix_vector_product(spark, sf_dir):
    from ..operators.vectorize import multiply

    v = CountVectorizer()
    docs = texts(spark, sf_dir)
    vocabulary = v.fit(docs)
    weights = vocabulary.select("col", (1.0 / (1 + F.col("df"))).alias("weight"))
    return multiply(v.transform(docs, vocabulary), weights, "doc_id").select("doc_id", r6("product"))


_HASHED = """
with recursive tok as (select doc_id, unnest({tokens}) as term from documents where text is not null),
w as (select term, hex(encode(term)) as b from (select distinct term from tok)),
ks as (select term, b, list_transform(range(0, (length(b) + 7) // 8), lambda i: list_reduce(list_transform(range(0, 4), lambda j:
  case when 8 * i + 2 * j < length(b) then ('0x' || substr(b, 8 * i + 2 * j + 1, 2))::bigint * (1 << (8 * j)) else 0 end), lambda x, y: x + y)) as ks from w),
sc as (select term, b, list_transform(list_transform(list_transform(ks, lambda k: (k::hugeint * 3432918353 % 4294967296)::bigint),
  lambda k: ((k << 15) & 4294967295) | (k >> 17)), lambda k: (k::hugeint * 461845907 % 4294967296)::bigint) as ks from ks),
hs as (select term, b, list_reduce(list_transform(range(1, len(ks) + 1), lambda i: case when 8 * i <= length(b) then ks[i] else -1 - ks[i] end), lambda h, k:
  case when k >= 0 then (((((xor(h, k) << 13) & 4294967295) | (xor(h, k) >> 19)) * 5 + 3864292196) & 4294967295) else xor(h, -1 - k) end, 0::bigint) as h from sc),
f0 as (select term, xor(h, length(b) // 2) as h from hs),
f1 as (select term, (xor(h, h >> 16)::hugeint * 2246822507 % 4294967296)::bigint as h from f0),
f2 as (select term, (xor(h, h >> 13)::hugeint * 3266489909 % 4294967296)::bigint as h from f1),
f3 as (select term, xor(h, h >> 16) as h from f2),
f4 as (select term, case when h >= 2147483648 then h - 4294967296 else h end as h from f3),
cell as (select doc_id, abs(h) % 262144 as col, sum(case when h < 0 then -1.0::double else 1.0::double end) as v from tok join f4 using (term) group by all having v <> 0),
vec as (select doc_id, col, v / sqrt(sum(v * v) over (partition by doc_id)) as value, v from cell)
"""


@query(_HASHED.format(tokens=_TOKENS) + "select doc_id, col, round(value, 6) as value from vec")
def hashing_vectorizer(spark, sf_dir):
    out = HashingVectorizer(HashOptions(n_features=1 << 18)).transform(texts(spark, sf_dir))
    return out.select("doc_id", "col", r6("value"))


@query(_HASHED.format(tokens=_TOKENS) + """select d.doc_id, coalesce(n, 0)::int as cells, coalesce(l1, 0) as l1 from documents d
left join (select doc_id, count(*) as n, round(sum(abs(value)), 6) as l1 from vec group by doc_id) using (doc_id)""")
def stream_hashing(spark, sf_dir):
    """hash_stream() over documents as a stream, run to its end."""
    from ..streaming.vectorize import hash_stream

    found = hash_stream(stream(spark, sf_dir, "documents"), HashOptions(n_features=1 << 18))
    return drain(found.select("doc_id", F.size("cells").alias("cells"), r6(F.aggregate("cells", F.lit(0.0), lambda s, c: s + F.abs(c["value"])), "l1")))


@query("select doc_id, strip_accents(lower(text)) as text from documents")
def strip_accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.prepare("text", accents=True).alias("text"))


# ---------------------------------------------------------------- saved and loaded again


def _place(spark) -> str:
    import uuid

    return f"{shared_dir(spark)}/quillspark-{uuid.uuid4().hex}"


@query(_count_sql())
def saved_count(spark, sf_dir):
    """A count vectorizer and its vocabulary, saved, loaded and applied."""
    v, docs, path = CountVectorizer(), texts(spark, sf_dir), _place(spark)
    artifacts.save_count(v, v.fit(docs), path)
    loaded, vocabulary = artifacts.load_count(spark, path)
    return loaded.transform(docs, vocabulary)


@query(_tfidf_sql(tf="ln(tf.tf) + 1"))
def saved_tfidf(spark, sf_dir):
    v, docs, path = TfidfVectorizer(TfidfOptions(sublinear_tf=True)), texts(spark, sf_dir), _place(spark)
    artifacts.save_tfidf(v, v.fit(docs), path)
    loaded, vocabulary = artifacts.load_tfidf(spark, path)
    return loaded.transform(docs, vocabulary).select("doc_id", "term", r6("value"))


@query(_HASHED.format(tokens=_TOKENS) + "select doc_id, col, round(v, 6) as value from vec")
def saved_hashing(spark, sf_dir):
    path = _place(spark)
    artifacts.save_hashing(spark, HashingVectorizer(HashOptions(n_features=1 << 18, norm=None)), path)
    return artifacts.load_hashing(spark, path).transform(texts(spark, sf_dir)).select("doc_id", "col", r6("value"))


_PART_WORDS = "select distinct unnest(string_split(lower(p_name), ' ')) as token from part"


def _part_words(spark, sf_dir):
    """The words of part names in order; they come to the driver, as a vocabulary file's lines do."""
    return table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("token")).distinct().orderBy("token")


def _write_line(spark, line: str) -> str:
    path = _place(spark)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(path)
    return path


@query(f"select token, row_number() over (order by encode(token)) as id from ({_PART_WORDS}) union all select '[UNK]', 0")
def vocab_txt(spark, sf_dir):
    """A vocabulary written as a text file and loaded."""
    path = _write_line(spark, "\n".join(["[UNK]", *(r.token for r in _part_words(spark, sf_dir).collect())]))
    return spark.createDataFrame(list(vocab.vocab_txt(spark, path).vocab.items()), "token string, id long")


@query(f"select token, row_number() over (order by encode(token)) as id from ({_PART_WORDS}) union all select '[UNK]', 0")
def wordpiece_json(spark, sf_dir):
    """A word-piece tokenizer.json written and loaded."""
    import json

    ids = {t: i for i, t in enumerate(["[UNK]", *(r.token for r in _part_words(spark, sf_dir).collect())])}
    model = {"type": "WordPiece", "unk_token": "[UNK]", "continuing_subword_prefix": "##", "max_input_chars_per_word": 100, "vocab": ids}
    path = _write_line(spark, json.dumps({"pre_tokenizer": {"type": "Whitespace"}, "model": model}))
    return spark.createDataFrame(list(vocab.wordpiece_json(spark, path).vocab.items()), "token string, id long")


@query(f"""with c as (select token, row_number() over (order by encode(token)) as id from ({_PART_WORDS}))
select chr(9601) || token as piece, -id::double as score, id from c union all select '<unk>', 0, 0""")
def unigram_json(spark, sf_dir):
    """A unigram tokenizer.json written and loaded."""
    import json

    rows = [["<unk>", 0.0], *([subword.META + r.token, -float(i)] for i, r in enumerate(_part_words(spark, sf_dir).collect(), 1))]
    spec = {"pre_tokenizer": {"type": "Metaspace", "replacement": subword.META, "prepend_scheme": "always"}, "model": {"type": "Unigram", "unk_id": 0, "vocab": rows}}
    pieces = vocab.unigram_json(spark, _write_line(spark, json.dumps(spec))).pieces
    return spark.createDataFrame([(p, s, i) for i, (p, s, _) in enumerate(pieces)], "piece string, score double, id long")


@query(_tfidf_sql().replace("tf.doc_id, tf.term, (", "tf.doc_id, voc.col, (").replace("select doc_id, term, round", "select doc_id, col, round"))
def tfidf_transformer(spark, sf_dir):
    """TF-IDF of a given count matrix."""
    docs = texts(spark, sf_dir)
    matrix = keep(CountVectorizer().fit_transform(docs).select("doc_id", "col", "value"))
    n, width = docs.where("text is not null").count(), matrix.agg(F.max("col")).first()[0] + 1
    t = TfidfTransformer()
    return t.transform(matrix, t.fit(matrix, n), width, width).select("doc_id", "col", r6("value"))


@query(f"""{_TF}, c as (select doc_id, length(term) % 16 as col, sum(tf) as value from tf group by all)
select doc_id, list_transform(range(0, 16), lambda j: coalesce(list_extract(map_extract(m, j), 1), 0)) as values
from (select doc_id, map(list(col), list(value)) as m from c group by doc_id)""")
def dense_rows(spark, sf_dir):
    """How many tokens of each length modulo 16 a text has, as one array a row."""
    counts = CountVectorizer().counts(texts(spark, sf_dir))
    cells = counts.groupBy("doc_id", (F.length("term") % 16).cast("long").alias("col")).agg(F.sum("tf").alias("value"))
    return to_dense(cells, "doc_id", 16)


@query(f"{_TF} select tok.doc_id, term, col, count(*) as n from tok join voc using (term) group by all")
def count_streaming(spark, sf_dir):
    """count_stream() over documents as a stream, run to its end."""
    from ..streaming.vectorize import count_stream

    found = count_stream(stream(spark, sf_dir, "documents"), keep(CountVectorizer().fit(texts(spark, sf_dir))))
    return drain(found).groupBy("doc_id", "term", "col").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- metrics

_LABELLED = "select l.quality as y_true, case when d.n_chars >= 1500 then 1 else 0 end as y_pred, floor(d.n_chars / 200) as score, 1 + d.doc_id % 3 as w from labels l join documents d using (doc_id) where l.quality is not null"


def _labelled(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return labels.join(docs, "doc_id").where("quality is not null").select(
        F.col("quality").alias("y_true"), F.when(F.col("n_chars") >= 1500, 1).otherwise(0).alias("y_pred"),
        F.floor(F.col("n_chars") / 200).cast("double").alias("score"), (1 + F.col("doc_id") % 3).cast("double").alias("w"),
    )


# Ten classes: each vector's nearest class centre by cosine, and the softmax of the cosines.
_CLASSES = """
with e as (select vec_id, label, i, embedding[i]::double as x from embeddings, range(1, 65) t(i)),
c as (select label as c, i, avg(x) as m from e group by all),
cn as (select c, i, m / sqrt(sum(m * m) over (partition by c)) as m from c),
n as (select vec_id, label, i, x / sqrt(sum(x * x) over (partition by vec_id)) as x from e),
s as (select vec_id, label, c, sum(x * m) as s from n join cn using (i) group by all),
p as (select vec_id, label, c, exp(5 * s) / sum(exp(5 * s)) over (partition by vec_id) as p, row_number() over (partition by vec_id order by round(s, 9) desc, c) as r from s),
classes as (select label as y_true, c as y_pred from p where r = 1)
"""


def _class_scores(spark, sf_dir) -> DataFrame:
    """(vec_id, label, c, p, r) as in the SQL; the class centres are a table of one row a class."""
    e = table(spark, sf_dir, "embeddings")
    x = e.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    centre = x.groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy(F.col("label").alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda t: t["m"]).alias("m"))
    centre = centre.select("c", T.l2_normalize("m").alias("m"))
    s = e.select("vec_id", "label", T.l2_normalize("embedding").alias("v")).join(F.broadcast(centre), how="cross").select("vec_id", "label", "c", T.dot("v", "m").alias("s"))
    w = W.partitionBy("vec_id")
    return s.select("vec_id", "label", "c", (F.exp(5 * F.col("s")) / F.sum(F.exp(5 * F.col("s"))).over(w)).alias("p"), F.row_number().over(w.orderBy(F.desc(F.round("s", 9)), "c")).alias("r"))


def _classes(spark, sf_dir):
    return _class_scores(spark, sf_dir).where("r = 1").select(F.col("label").alias("y_true"), F.col("c").alias("y_pred"))


@query(f"with x as ({_LABELLED}) select round(avg((y_true = y_pred)::int), 6) as accuracy from x")
def accuracy(spark, sf_dir):
    return metrics.accuracy(_labelled(spark, sf_dir)).select(r6("accuracy"))


@query(f"with x as ({_LABELLED}) select round(sum(w * (y_true = y_pred)::int), 6)::double as accuracy from x")
def accuracy_weighted_count(spark, sf_dir):
    return metrics.accuracy(_labelled(spark, sf_dir), weight="w", normalize=False).select(r6("accuracy"))


@query(f"""{_CLASSES}, l as (select y_true as l from classes union select y_pred from classes)
select a.l as y_true, b.l as y_pred, count(classes.y_true)::double as weight
from l a cross join l b left join classes on classes.y_true = a.l and classes.y_pred = b.l group by all""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_classes(spark, sf_dir)).matrix()


@query(f"""{_CLASSES} select round(sum((y_true = y_pred)::int) / count(*), 6) as accuracy from classes where y_true in (0, 2, 5) and y_pred in (0, 2, 5)""")
def confusion_subset_accuracy(spark, sf_dir):
    return metrics.confusion(_classes(spark, sf_dir), labels=[0, 2, 5]).accuracy().select(r6("accuracy"))


_PER_CLASS = f"""{_CLASSES}, l as (select y_true as l from classes union select y_pred from classes),
k as (select l, (select count(*) from classes where y_true = l and y_pred = l)::double as tp, (select count(*) from classes where y_pred = l)::double as pred, (select count(*) from classes where y_true = l)::double as support from l),
z as (select l, support, tp, pred, case when pred = 0 then 0 else tp / pred end as p, case when support = 0 then 0 else tp / support end as r, case when pred + support = 0 then 0 else 2 * tp / (pred + support) end as f,
case when pred + 4 * support = 0 then 0 else 5 * tp / (pred + 4 * support) end as f2 from k)
"""
_ROUND = "round({p}, 6) as precision, round({r}, 6) as recall, round({f}, 6) as fbeta, {s} as support"


@query(_PER_CLASS + "select l as label, " + _ROUND.format(p="p", r="r", f="f", s="support") + " from z")
def prf_per_class(spark, sf_dir):
    out = metrics.per_class(metrics.confusion(_classes(spark, sf_dir)))
    return out.select("label", r6("precision"), r6("recall"), r6("fbeta"), "support")


@query(_PER_CLASS + "select l as label, " + _ROUND.format(p="p", r="r", f="f2", s="support") + " from z")
def fbeta_2(spark, sf_dir):
    out = metrics.per_class(metrics.confusion(_classes(spark, sf_dir)), beta=2.0)
    return out.select("label", r6("precision"), r6("recall"), r6("fbeta"), "support")


def _average(kind):
    def run(spark, sf_dir):
        out = metrics.average(metrics.confusion(_classes(spark, sf_dir)), kind)
        return out.select(r6("precision"), r6("recall"), r6("fbeta"), "support")

    return run


query(_PER_CLASS + "select " + _ROUND.format(p="avg(p)", r="avg(r)", f="avg(f)", s="sum(support)") + " from z", "prf_macro")(_average("macro"))
query(_PER_CLASS + "select " + _ROUND.format(p="sum(p * support) / sum(support)", r="sum(r * support) / sum(support)", f="sum(f * support) / sum(support)", s="sum(support)") + " from z", "prf_weighted")(_average("weighted"))
query(_PER_CLASS + "select " + _ROUND.format(p="sum(tp) / sum(pred)", r="sum(tp) / sum(support)", f="2 * sum(tp) / (sum(pred) + sum(support))", s="sum(support)") + " from z", "prf_micro")(_average("micro"))


@query(f"""with x as ({_LABELLED}), k as (select sum(w) filter (where y_true = 1 and y_pred = 1)::double as tp, sum(w) filter (where y_pred = 1)::double as pred, sum(w) filter (where y_true = 1)::double as support from x)
select {_ROUND.format(p="tp / pred", r="tp / support", f="2 * tp / (pred + support)", s="support")} from k""")
def prf_binary(spark, sf_dir):
    out = metrics.average(metrics.confusion(_labelled(spark, sf_dir), weight="w"), "binary")
    return out.select(r6("precision"), r6("recall"), r6("fbeta"), "support")


@query(_PER_CLASS + """select 0 as section, l::varchar as name, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1, support from z
union all select 1, 'accuracy', null, null, round(sum(tp) / sum(support), 6), sum(support) from z
union all select 2, 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support) from z
union all select 3, 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), sum(support) from z""")
def classification_report(spark, sf_dir):
    out = metrics.report(metrics.confusion(_classes(spark, sf_dir)))
    return out.select("section", "name", r6("precision"), r6("recall"), r6("f1"), "support")


_PARTIAL = f"""with x as ({_LABELLED}), l as (select unnest([0, 1, 9]) as l),
k as (select l, (select count(*) from x where y_true = l and y_pred = l)::double as tp, (select count(*) from x where y_pred = l)::double as pred, (select count(*) from x where y_true = l)::double as support from l)
"""


@query(_PARTIAL + "select l as label, round(case when pred = 0 then 1 else tp / pred end, 6) as precision, round(case when support = 0 then 1 else tp / support end, 6) as recall, round(case when pred + support = 0 then 1 else 2 * tp / (pred + support) end, 6) as fbeta, support from k")
def prf_undefined_is_one(spark, sf_dir):
    out = metrics.per_class(metrics.confusion(_labelled(spark, sf_dir), labels=[0, 1, 9]), zero_division="one")
    return out.select("label", r6("precision"), r6("recall"), r6("fbeta"), "support")


@query(_PARTIAL + "select l as label, pred = 0 as precision, support = 0 as recall, pred + support = 0 as fbeta from k")
def prf_undefined_is_nan(spark, sf_dir):
    out = metrics.per_class(metrics.confusion(_labelled(spark, sf_dir), labels=[0, 1, 9]), zero_division="nan")
    return out.select("label", *[F.isnan(c).alias(c) for c in ("precision", "recall", "fbeta")])


@query(f"""{_PER_CLASS}, y as (select * from z where l in (0, 2, 5))
select 0 as section, l::varchar as name, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1, support from y
union all select 1, 'micro avg', round(sum(tp) / sum(pred), 6), round(sum(tp) / sum(support), 6), round(2 * sum(tp) / sum(pred + support), 6), sum(support) from y
union all select 2, 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support) from y
union all select 3, 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), sum(support) from y""")
def classification_report_subset(spark, sf_dir):
    out = metrics.report(metrics.confusion(_classes(spark, sf_dir), labels=[0, 2, 5]))
    return out.select("section", "name", r6("precision"), r6("recall"), r6("f1"), "support")


_LINE = "printf('%12s', {n}) || ' ' || {m} || printf(' %9.2f', {f}) || printf(' %9d', {s}::bigint)"
_THREE = "printf(' %9.2f %9.2f', {p}, {r})"


@query(_PER_CLASS + f"""select repeat(' ', 12) || ' ' || ' precision    recall  f1-score   support' || chr(10) || chr(10)
|| (select string_agg({_LINE.format(n="l::varchar", m=_THREE.format(p="p", r="r"), f="f", s="support")}, chr(10) order by l) from z) || chr(10) || chr(10)
|| (select {_LINE.format(n="'accuracy'", m="repeat(' ', 20)", f="sum(tp) / sum(support)", s="sum(support)")} || chr(10)
|| {_LINE.format(n="'macro avg'", m=_THREE.format(p="avg(p)", r="avg(r)"), f="avg(f)", s="sum(support)")} || chr(10)
|| {_LINE.format(n="'weighted avg'", m=_THREE.format(p="sum(p * support) / sum(support)", r="sum(r * support) / sum(support)"), f="sum(f * support) / sum(support)", s="sum(support)")} || chr(10) from z) as text""")
def classification_report_text(spark, sf_dir):
    text = metrics.report_text(metrics.report(metrics.confusion(_classes(spark, sf_dir))))
    return spark.createDataFrame([(text,)], "text string")


def _auc_sql(weight: str) -> str:
    return f"""with x as ({_LABELLED}), g as (select score, sum({weight}) filter (where y_true = 1) as p, sum({weight}) filter (where y_true <> 1) as f from x group by score),
h as (select coalesce(p, 0)::double as p, coalesce(f, 0)::double as f, sum(coalesce(p, 0)::double) over (order by score desc) as tp from g)
select round(sum(f * (2 * tp - p) / 2) / (sum(p) * sum(f)), 6) as auc from h"""


@query(_auc_sql("1"))
def roc_auc_binary(spark, sf_dir):
    return metrics.roc_auc(_labelled(spark, sf_dir)).select(r6("auc"))


@query(_auc_sql("w"))
def roc_auc_weighted(spark, sf_dir):
    return metrics.roc_auc(_labelled(spark, sf_dir), weight="w").select(r6("auc"))


def _score_rows(spark, sf_dir):
    s = _class_scores(spark, sf_dir)
    rows = s.groupBy("vec_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", F.round("p", 12).alias("p")))), lambda t: t["p"]).alias("scores"))
    return rows, [r.label for r in table(spark, sf_dir, "embeddings").select("label").distinct().orderBy("label").collect()]


_OVR = f"""{_CLASSES}, g as (select c, round(p, 12) as score, sum((label = c)::int)::double as pos, sum((label <> c)::int)::double as neg from p group by all),
h as (select *, sum(pos) over (partition by c order by score desc) as tp from g),
a as (select c, sum(neg * (2 * tp - pos) / 2) / (sum(pos) * sum(neg)) as auc, sum(pos) as n from h group by c)
"""


@query(_OVR + "select round(avg(auc), 6) as auc from a")
def roc_auc_ovr(spark, sf_dir):
    rows, labels = _score_rows(spark, sf_dir)
    return metrics.roc_auc_multiclass(rows, "label", "scores", labels).select(r6("auc"))


@query(_OVR + "select round(sum(auc * n) / sum(n), 6) as auc from a")
def roc_auc_ovr_weighted(spark, sf_dir):
    rows, labels = _score_rows(spark, sf_dir)
    return metrics.roc_auc_multiclass(rows, "label", "scores", labels, averaging="weighted").select(r6("auc"))


@query(f"""{_CLASSES}, l as (select distinct label as b from p),
o as (select a.c as a, l.b, round(a.p, 12) as score, (a.label = a.c)::int as pos from p a, l where l.b <> a.c and a.label in (a.c, l.b)),
g as (select a, b, score, sum(pos)::double as pos, sum(1 - pos)::double as neg from o group by all),
h as (select *, sum(pos) over (partition by a, b order by score desc) as tp from g),
u as (select a, b, sum(neg * (2 * tp - pos) / 2) / (sum(pos) * sum(neg)) as auc from h group by a, b)
select round(avg(auc), 6) as auc from u""")
def roc_auc_ovo(spark, sf_dir):
    rows, labels = _score_rows(spark, sf_dir)
    return metrics.roc_auc_multiclass(rows, "label", "scores", labels, "ovo").select(r6("auc"))


@query(f"""{_CLASSES}, l as (select distinct label as b from p),
o as (select a.c as a, l.b, round(a.p, 12) as score, (a.label = a.c)::int as pos from p a, l where l.b <> a.c and a.label in (a.c, l.b)),
g as (select a, b, score, sum(pos)::double as pos, sum(1 - pos)::double as neg from o group by all),
h as (select *, sum(pos) over (partition by a, b order by score desc) as tp from g),
u as (select a, b, sum(neg * (2 * tp - pos) / 2) / (sum(pos) * sum(neg)) as auc, sum(pos) + sum(neg) as n from h group by a, b)
select round(sum(auc * n) / sum(n), 6) as auc from u""")
def roc_auc_ovo_weighted(spark, sf_dir):
    rows, labels = _score_rows(spark, sf_dir)
    return metrics.roc_auc_multiclass(rows, "label", "scores", labels, "ovo", "weighted").select(r6("auc"))


# ---------------------------------------------------------------- pairs of texts

_PAIRS = "select p_partkey as id, p_name as a, lower(p_type) || substr(p_name, 1, p_size % 7) as b from part"


def _pairs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), F.concat(F.lower("p_type"), F.expr("substring(p_name, 1, p_size % 7)")).alias("b"))


def _pair_query(name: str, column, sql: str | None = None):
    """column: makes the expression, once there is a session."""

    def run(spark, sf_dir):
        return _pairs(spark, sf_dir).select("id", column().alias("value"))

    query(f"with x as ({_PAIRS}) select id, {sql} as value from x" if sql else None, name)(run)


_LONGER = "greatest(length(a), length(b))"
_pair_query("levenshtein", lambda: T.levenshtein("a", "b"), "levenshtein(a, b)::int")
_pair_query("levenshtein_similarity", lambda: r6(T.normalized_similarity(T.levenshtein("a", "b"), "a", "b")), f"round(1 - levenshtein(a, b) / {_LONGER}, 6)")
_HAMMING = "(abs(length(a) - length(b)) + len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))))"
_pair_query("hamming", lambda: T.hamming("a", "b"), f"{_HAMMING}::int")
_pair_query("hamming_similarity", lambda: r6(T.normalized_similarity(T.hamming("a", "b"), "a", "b")), f"round(1 - {_HAMMING} / {_LONGER}, 6)")


def _distance(name):
    return P.distance_functions()[name]


def _fuzzy(name):
    return P.fuzzy_functions()[name]


_pair_query("damerau", lambda: _distance("damerau")("a", "b"), "damerau_levenshtein(a, b)::int")
_pair_query("damerau_similarity", lambda: r6(T.normalized_similarity(_distance("damerau")("a", "b"), "a", "b")), f"round(1 - damerau_levenshtein(a, b) / {_LONGER}, 6)")
_pair_query("jaro", lambda: r6(_distance("jaro")("a", "b")), "round(jaro_similarity(a, b), 6)")
_pair_query("jaro_winkler", lambda: r6(_distance("jaro_winkler")("a", "b")), "round(jaro_winkler_similarity(a, b), 6)")
_PREFIX = "list_max(list_transform(range(0, 5), lambda i: case when length(a) >= i and substr(a, 1, i) = substr(b, 1, i) then i else 0 end))"
_pair_query("jaro_winkler_weight", lambda: r6(P.jaro_winkler(0.2)("a", "b")), f"round(case when jaro_similarity(a, b) <= 0.7 then jaro_similarity(a, b) else jaro_similarity(a, b) + {_PREFIX} * 0.2 * (1 - jaro_similarity(a, b)) end, 6)")
_pair_query("ratcliff", lambda: r6(_distance("ratcliff")("a", "b")))
_pair_query("levenshtein_normalized", lambda: r6(T.normalized_distance(T.levenshtein("a", "b"), "a", "b")), f"round(levenshtein(a, b) / {_LONGER}, 6)")

# Rows of the dynamic programme as a recursive query over the places of a, on distinct pairs.
_LCS = f"""
with recursive x as ({_PAIRS}), d as (select distinct a, b from x),
dp(a, b, i, r) as (
  select a, b, 0, list_transform(range(0, length(b) + 1), lambda j: 0::bigint) from d
  union all
  select a, b, i + 1, list_reduce(
    list_transform(range(1, length(b) + 1), lambda j: [case when substr(b, j, 1) = substr(a, i + 1, 1) then r[j] + 1 else r[j + 1] end]),
    lambda l, y: list_append(l, greatest(l[len(l)], y[1])), [0::bigint])
  from dp where i < length(a)
), f as (select a, b, r[len(r)] as l from dp where i = length(a))
"""


_OSA = f"""
with recursive x as ({_PAIRS}), d as (select distinct a, b from x),
dp(a, b, i, r, q) as (
  select a, b, 0, list_transform(range(0, length(b) + 1), lambda j: j::bigint), null::bigint[] from d
  union all
  select a, b, i + 1, list_reduce(
    list_transform(range(1, length(b) + 1), lambda j: [least(r[j + 1] + 1, r[j] + case when substr(b, j, 1) = substr(a, i + 1, 1) then 0 else 1 end,
      case when i > 0 and j > 1 and substr(a, i + 1, 1) = substr(b, j - 1, 1) and substr(a, i, 1) = substr(b, j, 1) then q[j - 1] + 1 else 1000000 end)]),
    lambda l, y: list_append(l, least(l[len(l)] + 1, y[1])), [(i + 1)::bigint]), r
  from dp where i < length(a)
), f as (select a, b, r[len(r)] as l from dp where i = length(a))
"""
query(f"{_OSA} select id, l::int as value from x join f using (a, b)", "osa")(lambda spark, sf_dir: _pairs(spark, sf_dir).select("id", _distance("osa")("a", "b").alias("value")))
query(f"{_OSA} select id, round(1 - l / {_LONGER}, 6) as value from x join f using (a, b)", "osa_similarity")(lambda spark, sf_dir: _pairs(spark, sf_dir).select("id", r6(T.normalized_similarity(_distance("osa")("a", "b"), "a", "b"), "value")))


def _lcs_query(name, column, sql):
    def run(spark, sf_dir):
        return _pairs(spark, sf_dir).select("id", column().alias("value"))

    query(f"{_LCS} select id, {sql} as value from x join f using (a, b)", name)(run)


_lcs_query("lcs", lambda: _distance("lcs_length")("a", "b"), "l::int")
_lcs_query("indel", lambda: _distance("indel")("a", "b"), "(length(a) + length(b) - 2 * l)::int")
_lcs_query("indel_similarity", lambda: r6(_distance("indel_similarity")("a", "b")), "round(2 * l / (length(a) + length(b)), 6)")
_lcs_query("fuzz_ratio", lambda: r6(_fuzzy("ratio")("a", "b")), "round(200 * l / (length(a) + length(b)), 6)")
_SUBSTRINGS = "list_max(list_transform(range(1, length(a) + 1), lambda i: list_max(list_transform(range(0, length(a) - i + 2), lambda n: case when contains(b, substr(a, i, n)) then n else 0 end))))"
_pair_query("lcs_substring", lambda: _distance("substring_length")("a", "b"), f"{_SUBSTRINGS}::int")
for _name in ("partial_ratio", "token_set_ratio", "partial_token_sort_ratio", "partial_token_set_ratio", "wratio"):
    _pair_query(_name, lambda n=_name: r6(_fuzzy(n)("a", "b")))
_SORTED = "select id, array_to_string(list_sort(list_filter(string_split(a, ' '), lambda t: t <> '')), ' ') as a, array_to_string(list_sort(list_filter(string_split(b, ' '), lambda t: t <> '')), ' ') as b from (" + _PAIRS + ")"
query(f"{_LCS.replace(_PAIRS, _SORTED)} select id, round(200 * l / (length(a) + length(b)), 6) as value from x join f using (a, b)", "token_sort_ratio")(lambda spark, sf_dir: _pairs(spark, sf_dir).select("id", r6(_fuzzy("token_sort_ratio")("a", "b"), "value")))


def _qgram_query(name, build, formula):
    def run(spark, sf_dir):
        return _pairs(spark, sf_dir).select("id", r6(build("a", "b", 2), "value"))

    grams = "list_transform(range(1, length({s})), lambda i: substr({s}, i, 2))"
    query(f"""with p as ({_PAIRS}), g as (select id, 1 as side, unnest({grams.format(s="a")}) as g from p union all select id, 2, unnest({grams.format(s="b")}) from p),
c as (select id, g, count(*) filter (where side = 1) as x, count(*) filter (where side = 2) as y from g group by all),
s as (select id, sum(least(x, y))::double as i, sum(x)::double as x, sum(y)::double as y from c group by id)
select id, round({formula}, 6) as value from s""", name)(run)


_qgram_query("jaccard_q2", T.jaccard, "i / (x + y - i)")
_qgram_query("sorensen_dice_q2", T.sorensen_dice, "2 * i / (x + y)")
_qgram_query("overlap_q2", T.overlap, "i / least(x, y)")
_qgram_query("tversky_q2", lambda a, b, q: T.tversky(a, b, q, 0.7, 0.2), "i / (i + 0.7 * (x - i) + 0.2 * (y - i))")
_qgram_query("cosine_q2", T.qgram_cosine, "i / sqrt(x * y)")


@query("""with q as (select distinct lower(p_type) as query from part where p_type is not null), c as (select distinct p_name as choice from part where p_name is not null),
s as (select query, choice, round(jaro_winkler_similarity(query, choice) * 100, 6) as score from q cross join c),
r as (select query, choice, p_partkey as index, score from s join part on p_name = choice where score >= 40),
k as (select *, row_number() over (partition by query order by score desc, index) as rank from r)
select query, choice, index, score, cast(rank as integer) as rank from k where rank <= 5""")
def process_extract(spark, sf_dir):
    """Every type name among the part names, by a scorer that the caller brings."""
    part = table(spark, sf_dir, "part")
    queries = part.select(F.lower("p_type").alias("query"))
    choices = part.select(F.col("p_name").alias("choice"), F.col("p_partkey").alias("index"))
    return fuzzy.extract(queries, choices, lambda a, b: F.round(_distance("jaro_winkler")(a, b) * 100, 6), 5, 40.0)


@query("""with q as (select distinct lower(p_type) as query from part where p_type is not null), c as (select distinct p_name as choice from part where p_name is not null),
s as (select query, choice, round(jaro_winkler_similarity(query, choice) * 100, 6) as score from q cross join c),
k as (select query, choice, p_partkey as index, score, row_number() over (partition by query order by score desc, p_partkey) as rank from s join part on p_name = choice where score >= 40)
select query, choice, index, score from k where rank = 1""")
def extract_one_by(spark, sf_dir):
    """The best part name of every type name, by a scorer that the caller brings."""
    part = table(spark, sf_dir, "part")
    choices = part.select(F.col("p_name").alias("choice"), F.col("p_partkey").alias("index"))
    return fuzzy.extract_one(part.select(F.lower("p_type").alias("query")), choices, lambda a, b: F.round(_distance("jaro_winkler")(a, b) * 100, 6), 40.0)


@query()
def extract_one(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    queries = part.select(F.lower("p_type").alias("query"))
    choices = part.select(F.col("p_name").alias("choice"), F.col("p_partkey").alias("index"))
    return fuzzy.extract_one(queries, choices)


@query("""with recursive p as (select p_partkey as id, p_name as t, p_brand as k from part), r as (select k, t, min(id) as id from p group by all),
e as (select x.id as a, y.id as b from r x join r y on x.k = y.k and x.id <> y.id and 1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)) >= 0.7),
reach(id, c) as (select id, id from r union select e.b, reach.c from reach join e on e.a = reach.id),
m as (select id, min(c) as c from reach group by id)
select p.id, m.c as cluster_id from p join r using (k, t) join m on m.id = r.id""")
def dedup_clusters(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), "p_brand")
    similarity = lambda a, b: T.normalized_similarity(T.levenshtein(a, b), a, b)
    return fuzzy.find_clusters(part, F.col("p_brand"), similarity, 0.7)


# ---------------------------------------------------------------- words

_DIGITS = "translate(upper(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"


def _words(spark, sf_dir):
    """The distinct words of all documents."""
    return texts(spark, sf_dir).select(F.explode(T.word_tokens(F.lower("text"))).alias("word")).distinct()


@query(f"""with t as (select distinct unnest({_TOKENS}) as word from documents), l as (select word, regexp_replace(upper(word), '[^A-Z]', '', 'g') as w from t),
d as (select word, w, translate(regexp_replace(substr(w, 1, 1) || substr(w, 2), '[HW]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202') as tail, substr(w, 1, 1) as head from l),
h as (select word, head, w, translate(head, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202') || translate(regexp_replace(substr(w, 2), '[HW]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202') as code from d),
s as (select word, head, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(code, '0+', '0', 'g'), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') as code from h)
select word, case when head = '' then '' else substr(head || replace(substr(code, 2), '0', '') || '000', 1, 4) end as code from s""")
def soundex(spark, sf_dir):
    return _words(spark, sf_dir).select("word", T.soundex("word").alias("code"))


def _word_query(name, column):
    query(None, name)(lambda spark, sf_dir: _words(spark, sf_dir).select("word", column().alias("code")))


for _name in ("metaphone", "nysiis"):
    _word_query(_name, lambda n=_name: P.phonetic_functions()[n]("word"))
for _lang in ("porter", "en", "fr", "de", "es", "it", "pt"):
    _word_query("porter" if _lang == "porter" else f"snowball_{_lang}", lambda g=_lang: P.stemmer(g)("word"))


# ---------------------------------------------------------------- vectors and sub-words


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as norm from embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(T.l2_norm("embedding"), "norm"))


@query("""with n as (select vec_id, label, list_transform(embedding::double[], lambda x: x / sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y)))) as v from embeddings),
q as (select * from n where vec_id % 20 = 0), s as (select q.vec_id as query_id, n.vec_id as id, list_inner_product(q.v, n.v) as s from q cross join n),
k as (select *, row_number() over (partition by query_id order by round(s, 9) desc, id) as rank from s)
select query_id, id, round(s, 6) as score, cast(rank as integer) as rank from k where rank <= 10""")
def knn_topk(spark, sf_dir):
    """Ten nearest by cosine; the stated queries are every row whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings")
    hits = vectors.VectorIndex.build(e, 64).search(e.where("vec_id % 20 = 0"), 10)
    return hits.select("query_id", "id", r6("score"), "rank")


@query(SQL["knn_topk"])
def saved_index(spark, sf_dir):
    """The index saved, loaded and searched."""
    e, path = table(spark, sf_dir, "embeddings"), _place(spark)
    artifacts.save_index(vectors.VectorIndex.build(e, 64), path)
    hits = artifacts.load_index(spark, path).search(e.where("vec_id % 20 = 0"), 10)
    return hits.select("query_id", "id", r6("score"), "rank")


@query("""with e as (select label, vec_id % 50 as g, vec_id % 3 as m, i, embedding[i]::double as x from embeddings, range(1, 65) t(i)),
p as (select label, g, i, coalesce(sum(x) filter (where m <> 0), 0) / greatest(count(*) filter (where m <> 0), 1e-9) as x from e group by all),
n as (select *, sqrt(sum(x * x) over (partition by label, g)) as n from p)
select label, g, list(round(case when n > 0 then x / n else x end, 6) order by i) as pooled from n group by label, g""")
def mean_pool(spark, sf_dir):
    """Vectors of a group stand for token embeddings; a third is masked."""
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 50).alias("g"), F.struct(F.col("embedding").alias("v"), (F.col("vec_id") % 3).alias("m")).alias("t"))
    rows = e.groupBy("label", "g").agg(F.collect_list("t").alias("t"))
    pooled = T.l2_normalize(T.mean_pool(F.transform("t", lambda t: t["v"]), F.transform("t", lambda t: t["m"])))
    return rows.select("label", "g", F.transform(pooled, lambda x: F.round(x, 6)).alias("pooled"))


def _wordpiece(spark, sf_dir):
    """A vocabulary made from the data: letters, their continuations, and frequent words."""
    text = table(spark, sf_dir, "conversations").where("text is not null")
    words = text.select(F.explode(T.word_tokens(F.lower("text"))).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(2000)
    letters = text.select(F.explode(F.array_distinct(F.split(F.lower("text"), ""))).alias("c")).where("c rlike '[^ \\\\s]'").distinct()
    w = [r.w for r in words.collect()]
    c = sorted(r.c for r in letters.collect())
    tokens = ["[UNK]", "[PAD]", "[CLS]", "[SEP]", *c, *(f"##{x}" for x in c), *(x for x in w if len(x) > 1)]
    return subword.WordPiece({t: i for i, t in enumerate(dict.fromkeys(tokens))}, lowercase=True)


@query()
def wordpiece(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    t = subword.tokenizer(_wordpiece(spark, sf_dir), rows)
    return rows.select("conv_id", "turn", t("text").alias("t")).select("conv_id", "turn", F.col("t.ids").alias("ids"))


@query()
def unigram(spark, sf_dir):
    import math

    rows = table(spark, sf_dir, "conversations")
    words = rows.where("text is not null").select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''").groupBy("w").count().orderBy(F.desc("count"), "w").limit(2000)
    got = [(r.w, r["count"]) for r in words.collect()]
    letters = sorted({c for w, _ in got for c in w})
    pieces = [("<unk>", 0.0, subword.UNKNOWN), (subword.META, -3.0, subword.NORMAL), *((c, -8.0, subword.NORMAL) for c in letters)]
    total = sum(n for _, n in got) or 1
    pieces += [(subword.META + w, math.log(n / total), subword.NORMAL) for w, n in got]
    t = subword.tokenizer(subword.Unigram(tuple(pieces)), rows)
    return rows.select("conv_id", "turn", t("text").alias("t")).select("conv_id", "turn", F.col("t.ids").alias("ids"))


_ENCODED = """with i as (select conv_id, turn, [(length(text) % 7)::bigint, turn::bigint + 10] || list_transform(range(0, length(text) % 40), lambda j: j % 100) as ids from conversations),
t as (select conv_id, turn, [2::bigint] || ids[1:30] || [3::bigint] as ids from i),
b as (select *, floor((row_number() over (partition by conv_id order by len(ids), turn) - 1) / 4)::bigint as batch_id from t),
w as (select *, max(len(ids)) over (partition by conv_id, batch_id) as n from b)
select conv_id, turn, batch_id, ids || list_transform(range(0, n - len(ids)), lambda j: 1::bigint) as input_ids,
       list_transform(range(0, n), lambda j: case when j < len(ids) then 1::bigint else 0::bigint end) as attention_mask, len(ids)::int as length from w"""


@query(_ENCODED)
def batch_encode(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    n = F.length("text") % 40
    body = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda j: (j % 100).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    ids = F.concat(F.array((F.length("text") % 7).cast("bigint"), F.col("turn").cast("bigint") + 10), body)
    options = vectors.EncodingOptions(max_length=32, batch_size=4)
    return vectors.encode_batches(rows.select("conv_id", "turn", ids.alias("ids")), vectors.BERT, {"[CLS]": 2, "[SEP]": 3, "[PAD]": 1}, options, "turn", "conv_id")


@query()
def embed_lookup(spark, sf_dir):
    """Word pieces, batches and a deterministic table encoder end to end."""
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    model = _wordpiece(spark, sf_dir)
    t = subword.tokenizer(model, rows)
    ids = rows.select("id", F.pmod(F.col("conv_id"), F.lit(16)).alias("g"), t("text").alias("t")).select("id", "g", F.col("t.ids").alias("ids"))
    encoded = vectors.encode_batches(ids, vectors.BERT, model.vocab, vectors.EncodingOptions(), "id", "g")
    size = max(model.vocab.values()) + 1
    lookup = [[((i * 31 + j * 17) % 101) / 101 - 0.5 for j in range(8)] for i in range(size)]
    out = vectors.embed(encoded, vectors.lookup_encoder(lookup))
    return out.select("id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))

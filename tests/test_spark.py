"""Operators on Spark: small definitions, edge rows, and every query against its SQL."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillspark.functions import pairs as P
from quillspark.functions import stopwords
from quillspark.functions import text as T
from quillspark.operators import fuzzy, metrics, vectors
from quillspark.operators.vectorize import CountOptions, CountVectorizer, HashingVectorizer, HashOptions, TfidfOptions, TfidfVectorizer, to_dense
from quillspark.sources import artifacts
from quillspark.sources.vocab import Limits
from quillspark.streaming.vectorize import hash_stream

DOCS = ["the cat sat on the mat", "a cat and a dog", "the dog barked loudly", "cats and dogs are friends", "the quick brown fox"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*enumerate(DOCS), (5, None), (6, "")], "doc_id long, text string")


def dense(cells, value="value"):
    return {(r.doc_id, r.term): r[value] for r in cells.collect()}


def test_counts_and_vocabulary(docs):
    got = dense(CountVectorizer().fit_transform(docs))
    assert got[0, "the"] == 2 and (1, "a") not in got and len({t for _, t in got}) == 16
    v = CountVectorizer().fit(docs).orderBy("col").collect()
    assert [r.term for r in v] == sorted(r.term for r in v) and [r.col for r in v] == list(range(16))


def test_count_limits(docs):
    two = CountVectorizer(CountOptions(min_df=2)).fit(docs)
    assert {r.term for r in two.collect()} == {"and", "cat", "dog", "the"}
    few = CountVectorizer(CountOptions(max_df=0.2)).fit(docs)
    assert not {"the", "cat"} & {r.term for r in few.collect()}


@pytest.mark.parametrize(
    ("options", "terms"),
    [
        (CountOptions(ngrams=(1, 2)), ["ab", "cd", "ef", "ab cd", "cd ef"]),
        (CountOptions(analyzer="char", ngrams=(4, 5)), ["ab c", "b cd", " cd ", "cd e", "d ef", "ab cd", "b cd ", " cd e", "cd ef"]),
        (CountOptions(analyzer="char_wb", ngrams=(3, 5)), [" ab", "ab ", " ab ", " cd", "cd ", " cd ", " ef", "ef ", " ef "]),
        (CountOptions(analyzer="char_wb", ngrams=(5, 6)), [" ab ", " cd ", " ef "]),
        (CountOptions(stop_words=("cd",), ngrams=(2, 2)), ["ab ef"]),
    ],
)
def test_analyzers(spark, options, terms):
    df = spark.createDataFrame([("Ab  cd\tef",)], "text string")
    assert df.select(options.terms("text").alias("t")).first().t == terms


def test_tfidf(docs):
    got = dense(TfidfVectorizer(TfidfOptions(norm=None)).fit_transform(docs))
    # six documents have a text, the empty one included
    assert got[0, "the"] == pytest.approx(2 * (math.log(7 / 4) + 1))
    unit = dense(TfidfVectorizer().fit_transform(docs))
    assert sum(v * v for (d, _), v in unit.items() if d == 2) == pytest.approx(1)
    known = TfidfVectorizer().fit(docs)
    assert not TfidfVectorizer().transform(docs.where("doc_id > 4"), known).count()


def test_hashing_matches_frozen_cells(docs):
    out = HashingVectorizer(HashOptions(n_features=16, norm=None)).transform(docs.where("doc_id = 0"))
    assert {(r.col, r.value) for r in out.collect()} == {(4, 1.0), (11, -1.0), (14, -2.0)}
    same = hash_stream(docs.where("doc_id = 0"), HashOptions(n_features=16, norm=None)).first().cells
    assert {(c.col, c.value) for c in same} == {(4, 1.0), (11, -1.0), (14, -2.0)}


def test_dense_rows(docs):
    cells = CountVectorizer().fit_transform(docs)
    assert sum(to_dense(cells, "doc_id", 16).where("doc_id = 0").first()["values"]) == 6


def pair(spark, a, b, *columns):
    return tuple(spark.createDataFrame([(a, b)], "a string, b string").select(*columns).first())


@pytest.mark.parametrize(("a", "b", "want"), [("cat", "cot", 0.5), ("abc", "", 0.0), ("", "", 1.0), ("aab", "ab", 2 / 3)])
def test_jaccard_counts_grams(spark, a, b, want):
    assert pair(spark, a, b, T.jaccard("a", "b"))[0] == pytest.approx(want)


def test_similarities_of_nothing(spark):
    cols = [T.sorensen_dice("a", "b"), T.overlap("a", "b"), T.qgram_cosine("a", "b"), T.tversky("a", "b")]
    assert pair(spark, "", "", *cols) == (1, 1, 1, 1)
    assert pair(spark, "x", "", *cols) == (0, 0, 0, 0)


def test_edit_columns(spark):
    cols = [T.levenshtein("a", "b"), T.levenshtein("a", "b", 2), T.hamming("a", "b"), T.normalized_similarity(T.hamming("a", "b"), "a", "b")]
    assert pair(spark, "kitten😀", "sitting", *cols) == (3, -1, 3, pytest.approx(4 / 7))
    assert pair(spark, None, "x", *cols) == (None, None, None, None)
    assert pair(spark, "", "", *cols) == (0, 0, 0, 1.0)


def test_kernels_count_units(spark):
    points, units = (P.distance_functions(u)["indel"]("a", "b") for u in (False, True))
    assert pair(spark, "😀", "", points, units) == (1, 2)


@pytest.mark.parametrize(("word", "code"), [("Robert", "R163"), ("Ashcraft", "A261"), ("1abc", "A120"), ("12", ""), (None, None)])
def test_soundex(spark, word, code):
    assert pair(spark, word, "", T.soundex("a"))[0] == code


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [[1.0, 2.0], [9.0, 9.0], [3.0, 4.0]], [1, 0, 1])], "a array<float>, z array<float>, t array<array<float>>, m array<bigint>")
    r = df.select(T.dot("a", "a").alias("d"), T.l2_normalize("a").alias("n"), T.l2_normalize("z").alias("z"), T.mean_pool("t", "m").alias("p")).first()
    assert (r.d, r.n, r.z, r.p) == (25, [0.6, 0.8], [0, 0], [2, 3])
    with pytest.raises(PySparkException):
        df.select(T.dot("a", F.array(F.lit(1.0)))).collect()


TRUE = [0] * 190 + [1] * 10
PRED = [0] * 133 + [1] * 57 + [0] * 4 + [1] * 6


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(list(zip(TRUE, PRED, strict=True)), "y_true int, y_pred int")


def test_averages(labelled):
    c = metrics.confusion(labelled)
    f = {k: metrics.average(c, k).first().fbeta for k in ("macro", "weighted", "micro")}
    assert [round(f[k], 3) for k in ("macro", "weighted", "micro")] == [0.489, 0.781, 0.695]
    assert metrics.average(c, "binary").first().recall == 0.6
    assert {(r.y_true, r.y_pred): r.weight for r in c.matrix().collect()} == {(0, 0): 133, (0, 1): 57, (1, 0): 4, (1, 1): 6}


def test_report_text(labelled):
    text = metrics.report_text(metrics.report(metrics.confusion(labelled)))
    assert text.splitlines()[0] == "              precision    recall  f1-score   support"
    assert "    accuracy                           0.69       200" in text or "    accuracy                           0.70       200" in text


def test_zero_division_and_subsets(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "y_true int, y_pred int")
    one = metrics.per_class(metrics.confusion(df), zero_division="one").where("label = 2").first()
    assert one.precision == 1 and one.recall == 0
    with pytest.raises(PySparkException):
        metrics.per_class(metrics.confusion(df), zero_division="throw").collect()
    part = metrics.confusion(df, labels=[0, 2])
    assert [r.name for r in metrics.report(part).orderBy("section").collect()][2] == "micro avg"
    for bad in ([0, 0], [7]):
        with pytest.raises(ValueError):
            metrics.confusion(df, labels=bad)


def test_roc_auc_counts_ties_half(spark):
    rows = [(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)]
    df = spark.createDataFrame(rows, "y_true int, score double")
    pairs = [(p > n) + (p == n) / 2 for y, p in rows if y for z, n in rows if not z]
    assert metrics.roc_auc(df).first().auc == pytest.approx(sum(pairs) / len(pairs))
    for bad in (df.where("y_true = 1"), df.withColumn("score", F.lit(float("nan")))):
        with pytest.raises(PySparkException):
            metrics.roc_auc(bad).collect()


def test_extract(spark):
    choices = "new york mets|new york yankees|boston red sox|atlanta braves|new york knicks".split("|")
    q = spark.createDataFrame([("new york",)], "query string")
    c = spark.createDataFrame([(t, i) for i, t in enumerate(choices)], "choice string, index int")
    got = fuzzy.extract(q, c, limit=4).orderBy("rank").collect()
    assert [(r["index"], round(r.score)) for r in got] == [(0, 90), (1, 90), (4, 90), (2, 45)]
    assert fuzzy.extract_one(q, c, cutoff=99).count() == 0


def test_clusters_close_over_blocks(spark):
    rows = [(1, "aaaa", "x"), (2, "aaab", "x"), (3, "aabb", "x"), (4, "aaaa", "y"), (5, "zzzz", "x"), (6, "aaaa", "x")]
    df = spark.createDataFrame(rows, "id int, text string, k string")
    sim = lambda a, b: T.normalized_similarity(T.levenshtein(a, b), a, b)
    got = {r.id: r.cluster_id for r in fuzzy.find_clusters(df, F.col("k"), sim, 0.75).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 1}


def test_batches(spark):
    df = spark.createDataFrame([(1, [5, 6, 7]), (2, []), (3, [8])], "id int, ids array<int>")
    names = {"[CLS]": 1, "[SEP]": 2, "[PAD]": 0}
    got = {r.id: r for r in vectors.encode_batches(df, vectors.BERT, names, vectors.EncodingOptions(max_length=4, batch_size=2)).collect()}
    assert got[1].input_ids == [1, 5, 6, 2] and got[2].input_ids == [1, 2, 0] and got[2].attention_mask == [1, 1, 0]
    out = vectors.embed(vectors.encode_batches(df, vectors.BERT, names), vectors.lookup_encoder([[i, 1.0] for i in range(9)]))
    assert {r.id: round(r.embedding[0], 4) for r in out.collect()}[2] == round(1.5 / (1.5**2 + 1) ** 0.5, 4)
    with pytest.raises(PySparkException):
        vectors.encode_batches(df, vectors.BERT, names, vectors.EncodingOptions(max_length=3, truncation="none")).collect()


def test_artifacts_round_trip(spark, docs, tmp_path):
    v = TfidfVectorizer(TfidfOptions(count=CountOptions(ngrams=(1, 2))))
    known = v.fit(docs)
    artifacts.save_tfidf(v, known, f"{tmp_path}/t")
    w, again = artifacts.load_tfidf(spark, f"{tmp_path}/t")
    assert w == v and sorted(map(tuple, again.collect())) == sorted(map(tuple, known.select(again.columns).collect()))
    h = HashingVectorizer(HashOptions(norm="l1"))
    artifacts.save_hashing(spark, h, f"{tmp_path}/h")
    assert artifacts.load_hashing(spark, f"{tmp_path}/h") == h
    index = vectors.VectorIndex.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "vec_id int, embedding array<float>"), 2)
    artifacts.save_index(index, f"{tmp_path}/i")
    again = artifacts.load_index(spark, f"{tmp_path}/i")
    q = spark.createDataFrame([(9, [0.0, 2.0])], "vec_id int, embedding array<float>")
    assert [r.id for r in again.search(q, 1).collect()] == [2]
    with pytest.raises(ValueError):
        artifacts.load_count(spark, f"{tmp_path}/t")


@pytest.mark.parametrize("kind", ["count", "tfidf"])
def test_a_large_vocabulary_loads(spark, tmp_path, kind):
    """Over a million terms, one of them of 2,000 characters; a limit that is given still holds."""
    term = F.when(F.col("id") == 0, F.lpad(F.lit("0"), 2000, "0")).otherwise(F.concat(F.lit("1"), F.lpad(F.col("id").cast("string"), 7, "0")))
    known = spark.range(1_000_001).select(term.alias("term"), F.col("id").alias("col"), F.lit(1).cast("long").alias("df"), F.lit(9).cast("long").alias("n"), F.lit(1.0).alias("idf"))
    save, load, v = {"count": (artifacts.save_count, artifacts.load_count, CountVectorizer()), "tfidf": (artifacts.save_tfidf, artifacts.load_tfidf, TfidfVectorizer())}[kind]
    save(v, known, f"{tmp_path}/v")
    assert load(spark, f"{tmp_path}/v")[1].count() == 1_000_001
    for small in (Limits(token_length=3000), Limits(vocabulary=2_000_000)):
        with pytest.raises(ValueError):
            load(spark, f"{tmp_path}/v", small)


def test_stop_words(spark):
    assert len(stopwords.FRENCH) == 154 and "der" in stopwords.stop_words(spark, "de")


def entry():
    import __spark_entry__

    return __spark_entry__


NAMES = [n for n in entry().queries() if n in entry().oracle_sql() and not n.startswith("op") and n not in ("knn_topk", "roc_auc_ovo")]


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings", "conversations", "part"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, list):
        return tuple(map(plain, v))
    return None if v is None else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = entry().queries()[name](spark, sf_dir)
    want = duck.sql(entry().oracle_sql()[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    left = sorted((tuple(map(plain, r)) for r in got.select(cols).collect()), key=repr)
    right = sorted((tuple(map(plain, r)) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=repr)
    assert left == right


@pytest.mark.parametrize("name", ["count_streaming", "stream_hashing"])
def test_streams_read_a_folder_of_files(spark, sf_dir, tmp_path, name):
    """A table of several files, beside another one, gives what the table of one file gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 4 = 0")
    docs.coalesce(1).write.parquet(f"{tmp_path}/one/x")
    (one,) = (tmp_path / "one/x").glob("*.parquet")
    one.rename(tmp_path / "one/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/many/documents.parquet")
    docs.write.parquet(f"{tmp_path}/many/documents.parquet.old")
    one, many = (sorted(map(tuple, entry().queries()[name](spark, f"{tmp_path}/{d}").collect())) for d in ("one", "many"))
    assert one and one == many


def test_embeddings_pool_whole_texts(spark, sf_dir):
    import numpy as np

    from quillspark.plans import queries as Q

    got = {r.id: r.embedding for r in Q.embed_lookup(spark, sf_dir).collect()}
    ids = {f"{r.conv_id}:{r.turn}": r.ids for r in Q.wordpiece(spark, sf_dir).collect() if r.ids is not None}
    longest = max(ids, key=lambda k: len(ids[k]))
    assert len(ids[longest]) > 126
    v = np.mean([[((i * 31 + j * 17) % 101) / 101 - 0.5 for j in range(8)] for i in [2, *ids[longest], 3]], axis=0)
    assert np.allclose(got[longest], v / np.linalg.norm(v), atol=1e-4)

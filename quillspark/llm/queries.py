"""The registered queries: each operator with production parameters on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import decontam, langid, linededup, minhash, packing, quality, secrets, sharding, tokenbin, topk


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _remainder(m: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % m


def op1_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_size(C.table(spark, sf_dir, "documents"), 8)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (C.table(spark, sf_dir, t) for t in ("documents", "labels"))
    learn = labels.where(_remainder(5) != 0)
    scored = quality.score(docs, quality.fit(docs, learn))
    held = F.coalesce(_remainder(5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs.where(_remainder(4) != 2)))
    held = F.coalesce(_remainder(4) == 2, F.lit(False))
    return found.select(F.col("doc_id").cast("long"), held.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards to the shared folder and returns what their records hold."""
    out = C.Scratch(spark).path()
    if not tokenbin.write_shards(C.table(spark, sf_dir, "documents"), out, tokenizer_path()):
        return spark.createDataFrame([], "slot long, shard int, place long, doc_id long, start long, used long, ids_crc32 long")
    return tokenbin.read_shards(spark, out).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "embeddings").select("vec_id", topk.whole().alias("v"))
    return topk.search(rows.where("vec_id % 20 = 0"), rows, 20)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.remove_boilerplate(C.table(spark, sf_dir, "documents"))
    return found.select(F.col("doc_id").cast("long"), "text", "n_lines", "n_removed")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(secrets.samples(docs)))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(C.table(spark, sf_dir, "documents"), tokenizer_path(), 1024, 2)


def op10_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(C.table(spark, sf_dir, "documents"), k=3, percent=85)


def queries() -> dict:
    found = (op1_lpt_sharding, op2_decontamination, op3_quality, op4_language_id, op5_training_order, op6_exact_topk, op7_line_dedup, op8_secrets, op9_best_fit_packing, op10_minmax_near_dedup)
    return {f.__name__: f for f in found}


OP6_SQL = """
with w as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 64) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, r.vec_id as vec_id,
         cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * r.v[i])) as bigint) as score
  from w q join w r on q.vec_id <> r.vec_id and len(q.v) = len(r.v)
  where q.vec_id % 20 = 0
), n as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, score from n where rank <= 20
"""

OP7_SQL = f"""
with l as (
  select rowid as r, source, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as i
  from (select row_number() over () as rowid, * from documents where text is not null)
), wide as (
  select line from l where line <> '' group by line having count(distinct source) >= {linededup.SITES}
), m as (
  select l.*, wide.line is not null as gone from l left join wide on l.line = wide.line
), t as (
  select r, count(*) as n, count(*) filter (where gone) as k,
         bool_or(not gone and regexp_matches(line, '\\S')) as own,
         coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '') as rest
  from m group by r
)
select d.doc_id, case when t.k > 0 and t.own then t.rest else d.text end as text,
       coalesce(t.n, 0) as n_lines, case when t.k > 0 and t.own then t.k else 0 end as n_removed
from (select row_number() over () as rowid, * from documents where text is not null
      union all by name select null as rowid, * from documents where text is null) d
left join t on d.rowid = t.r
"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP10_SQL = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') as w from documents
), g as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from w
), n as (
  select w.doc_id, count(g.g) as n from w left join g on g.doc_id = w.doc_id group by w.doc_id
), b as (
  select x.doc_id as a, y.doc_id as b, count(*) as k from g x join g y on x.g = y.g and x.doc_id <> y.doc_id group by all
), e as (
  select b.a, b.b from b join n x on x.doc_id = b.a join n y on y.doc_id = b.b where 100 * b.k >= 85 * (x.n + y.n - b.k)
), r(doc_id, c) as (
  select doc_id, doc_id from n union select e.b, r.c from r join e on e.a = r.doc_id
), m as (
  select doc_id, min(c) as c from r group by doc_id
)
select n.doc_id, n.n as n_shingles, m.c as component_id, m.c = n.doc_id as kept from n join m on m.doc_id = n.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_minmax_near_dedup": OP10_SQL, "op6_exact_topk": OP6_SQL, "op7_line_dedup": OP7_SQL}

"""Vector index, exact cosine search, batch encoding and pluggable embedding."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T


#: Bytes of queries that are broadcast at once.
QUERY_BYTES = 64 << 20


@dataclass(frozen=True)
class VectorIndex:
    """Rows (id, vector): the stored vectors, normalised on the way in unless told otherwise."""

    rows: DataFrame
    dimension: int
    normalized: bool = True

    @staticmethod
    def build(df: DataFrame, dimension: int, key: str = "vec_id", vector: str = "embedding", normalize: bool = True) -> VectorIndex:
        """Null ids and vectors drop out; another length is an error."""
        v = T.l2_normalize(vector) if normalize else F.transform(vector, lambda x: x.cast("double"))
        v = F.when(F.size(vector) == dimension, v).otherwise(F.raise_error(F.lit(f"vectors must have {dimension} components")).cast("array<double>"))
        rows = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), v.alias("vector"))
        return VectorIndex(rows, dimension, normalize)

    def search(self, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block_bytes: int = QUERY_BYTES) -> DataFrame:
        """(query_id, id, score, rank): each query's min(k, count) highest products, ties by id.

        queries is a stated set. It meets all rows in blocks of at most block_bytes, each broadcast;
        a block is one pass of matrix products over the rows, and only k rows per query and input
        batch leave a task.
        """
        if k < 1:
            raise ValueError("k must be 1 or more")
        asked = VectorIndex.build(queries, self.dimension, key, vector, self.normalized).rows
        schema = f"query_id {dict(asked.dtypes)['id']}, id {dict(self.rows.dtypes)['id']}, score double"
        kind = to_arrow_type(asked.schema["id"].dataType)
        parts = [self._block(block, k, schema, kind) for block in _query_blocks(asked, max(1, block_bytes // (8 * self.dimension)))]
        out = self.rows.sparkSession.createDataFrame([], schema) if not parts else parts[0]
        for part in parts[1:]:
            out = out.union(part)
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id"))
        return out.withColumn("rank", rank).where(F.col("rank") <= k)

    def _block(self, block: tuple[list, np.ndarray], k: int, schema: str, kind) -> DataFrame:
        held = self.rows.sparkSession.sparkContext.broadcast(block)

        def score(batches):
            import pyarrow as pa

            ids, q = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                n = min(k, len(x))
                for i in range(0, len(q), 256):
                    s = q[i : i + 256] @ x.T
                    at, row = np.nonzero(s >= np.partition(s, -n, axis=1)[:, -n, None])
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i + j] for j in at], kind), batch.column("id").take(pa.array(row)), pa.array(s[at, row])], names=["query_id", "id", "score"])

        return self.rows.mapInArrow(score, schema)


def _query_blocks(asked: DataFrame, rows: int):
    """(ids, vectors) of at most `rows` queries each."""
    ids, vecs = [], []
    for r in asked.toLocalIterator():
        ids.append(r.id)
        vecs.append(r.vector)
        if len(ids) == rows:
            yield ids, np.array(vecs)
            ids, vecs = [], []
    if ids:
        yield ids, np.array(vecs)


# ---------------------------------------------------------------- batch encoding


@dataclass(frozen=True)
class Template:
    """Special tokens by name."""

    prefix: tuple[str, ...] = ()
    suffix: tuple[str, ...] = ()
    pad: str = "[PAD]"


BERT = Template(("[CLS]",), ("[SEP]",), "[PAD]")
ROBERTA = Template(("<s>",), ("</s>",), "<pad>")
T5 = Template((), ("</s>",), "<pad>")
NONE = Template((), (), "<pad>")


@dataclass(frozen=True)
class EncodingOptions:
    """truncation: longest_first, right (the same on single texts) or none, which fails on longer texts."""

    max_length: int | None = None
    truncation: str = "longest_first"
    batch_size: int = 32
    sort_by_length: bool = True


def encode_batches(ids: DataFrame, template: Template, token_ids: dict[str, int], options: EncodingOptions = EncodingOptions(), key: str = "id", group: str | None = None) -> DataFrame:
    """(id, batch_id, input_ids, attention_mask, length) from (id, ids array<int>): special tokens
    put around, truncated, padded to the longest of the batch, at least one wide.

    Batches are runs of batch_size rows by (length, id), or by id; within `group` if given, which
    is what keeps a large table from being one sequence of batches.
    """
    missing = [t for t in (*template.prefix, *template.suffix, template.pad) if t not in token_ids]
    if missing:
        raise ValueError(f"no ids for {missing}")
    special = len(template.prefix) + len(template.suffix)
    lit = lambda names: F.array(*[F.lit(token_ids[t]).cast("bigint") for t in names]).cast("array<bigint>")
    body = F.transform("ids", lambda x: x.cast("bigint"))
    if options.max_length is not None:
        room = options.max_length - special
        if room < 0:
            raise ValueError("max_length leaves no room for the special tokens")
        cut = F.slice(body, 1, room) if room else F.array().cast("array<bigint>")
        long = F.raise_error(F.lit("a text is longer than max_length")).cast("array<bigint>") if options.truncation == "none" else cut
        body = F.when(F.size("ids") > room, long).otherwise(body)
    full = ids.withColumn("_ids", F.concat(lit(template.prefix), body, lit(template.suffix))).withColumn("length", F.size("_ids"))
    keys = [group] if group else []
    order = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    order = order.orderBy(*(["length"] if options.sort_by_length else []), key)
    full = full.withColumn("batch_id", F.floor((F.row_number().over(order) - 1) / options.batch_size))
    width = F.greatest(F.max("length").over(W.partitionBy(*keys, "batch_id")), F.lit(1))
    full = full.withColumn("_w", width)
    pad = lambda x, n: F.array_repeat(F.lit(x).cast("bigint"), n)
    return full.select(
        key, *keys, "batch_id",
        F.concat("_ids", pad(token_ids[template.pad], F.col("_w") - F.col("length"))).alias("input_ids"),
        F.concat(pad(1, F.col("length")), pad(0, F.col("_w") - F.col("length"))).alias("attention_mask"), "length",
    )


# ---------------------------------------------------------------- embedding

#: Given batch arrays (input_ids, attention_mask), returns [n, dim] or [n, tokens, dim].
Encoder = Callable[[np.ndarray, np.ndarray], np.ndarray]


def onnx_encoder(path: str) -> Callable[[], Encoder]:
    """A factory of encoders on an ONNX model; each worker opens its own session. Inputs that the
    model declares are given; token types are zeros."""

    def make() -> Encoder:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(path, options)
        names = {i.name for i in session.get_inputs()}
        if "input_ids" not in names:
            raise ValueError("the model has no input_ids")

        def run(ids, mask):
            feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            return session.run(None, {k: v for k, v in feed.items() if k in names})[0]

        return run

    return make


def lookup_encoder(table: list[list[float]]) -> Callable[[], Encoder]:
    """A deterministic encoder that gives each token its row of the table."""
    return lambda: lambda ids, mask: np.asarray(table, np.float32)[ids]


def embed(batches: DataFrame, make: Callable[[], Encoder], key: str = "id") -> DataFrame:
    """(id, embedding array<float>) from encode_batches(): token vectors are mean-pooled over the
    mask and normalised, sentence vectors only normalised."""
    kind = dict(batches.dtypes)[key]

    def run(frames):
        import pandas as pd

        encoder = make()
        for f in frames:
            out = []
            for _, g in f.groupby(f["input_ids"].map(len)):
                ids, mask = (np.stack(g[c].to_list()).astype(np.int64) for c in ("input_ids", "attention_mask"))
                v = np.asarray(encoder(ids, mask), np.float64)
                if v.ndim == 3:
                    m = (mask != 0)[:, :, None]
                    v = (v * m).sum(1) / np.maximum(m.sum(1), 1e-9)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, n, out=v.copy(), where=n > 0)
                out.append(pd.DataFrame({key: g[key], "embedding": list(v.astype(np.float32))}))
            yield pd.concat(out) if out else pd.DataFrame({key: [], "embedding": []})

    return batches.select(key, "input_ids", "attention_mask").mapInPandas(run, f"{key} {kind}, embedding array<float>")

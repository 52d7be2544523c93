"""Training-order materialisation of token sequences as fixed-stride binary shards.

The token stream (each document's ids, then the end id) is cut into sequences of `length`
ids; a stream runs through one input split, whose last sequence is padded. A split can't have
more sequences than its bytes and rows allow (a byte-level id holds a byte at least), so a pass
over the lengths gives every split its own range of sequence numbers, and texts are tokenised
once. A keyed Feistel permutation with cycle-walking takes each sequence number to a place of
its own among all numbers. Ranges of places are the shards: the rows of a range are dealt to one
partition by its number, sorted by place and written as one file of records, each
`stride(length)` bytes. Numbers that no sequence has leave no hole: a sequence's slot is its
rank by place, which is its record's position after the records of the shards before. The
manifest, a row a shard, has those offsets, so a reader goes to any slot at once, in order or
after a restart.

Record: doc_id of the first token, place (int64), ids in use, first token's place in its
document (uint32), `length` ids (uint16; uint32 for vocabularies over 65,536), end mark "SEQ\n".
All numbers are little-endian. Files are written by Spark's text writer, so a task that is lost
or runs twice leaves one committed copy.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64

HEAD = np.dtype([("doc_id", "<i8"), ("place", "<i8"), ("used", "<u4"), ("start", "<u4")])
MARK = b"SEQ\n"
ROUNDS = 6
SHARD_BYTES = 32 << 20  # of text to a shard, about


def stride(length: int, width: int = 2) -> int:
    return HEAD.itemsize + length * width + len(MARK)


class Permutation:
    """A keyed bijection of 0..n-1: a balanced Feistel network on the next even number of bits,
    applied again while the value is outside (under four times on average)."""

    def __init__(self, n: int, key: str):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        seed = hashlib.sha256(key.encode()).digest()
        self.keys = np.frombuffer(hashlib.sha256(seed).digest() + hashlib.sha256(seed + b"2").digest(), np.uint64)[:ROUNDS]

    def _once(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        h, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & low
        for k in self.keys[::-1] if inverse else self.keys:
            if inverse:
                left, right = right ^ (mix64(left ^ k) & low), left
            else:
                left, right = right, left ^ (mix64(right ^ k) & low)
        return (left << h) | right

    def __call__(self, x, inverse: bool = False) -> np.ndarray:
        y = self._once(np.asarray(x, np.uint64), inverse)
        while (out := y >= self.n).any():
            y[out] = self._once(y[out], inverse)
        return y.astype(np.int64)


def _streams(batches, path, length, end_id):
    """Sequences of one split's stream as (doc_id of the first token, its place there, ids)."""
    from .bpe import encoder

    enc, last = encoder(path), np.array([end_id], "<u4")
    held = np.empty(0, "<u4")
    owners: list[tuple[int, int, int]] = []  # (place in held, doc_id, place in the document)
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids = np.concatenate([np.frombuffer(enc.ids(text.as_py() or ""), "<u4"), last])
            owners.append((len(held), -1 if doc_id is None else doc_id, 0))
            held = np.concatenate([held, ids])
            at = 0
            while len(held) - at >= length:
                while len(owners) > 1 and owners[1][0] <= at:
                    owners.pop(0)
                p, d, s = owners[0]
                yield d, s + at - p, held[at : at + length]
                at += length
            held = held[at:]
            while len(owners) > 1 and owners[1][0] <= at:
                owners.pop(0)
            owners = [(p - at, d, s) for p, d, s in owners]
    if len(held):
        p, d, s = owners[0]
        yield d, s - p, held


def room(docs: DataFrame, length: int) -> tuple[dict[int, tuple[int, int]], int]:
    """({split: (its first sequence number, how many it may have)}, all of them); a row a split."""
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("ids")
    found, base = {}, 0
    for r in docs.groupBy(F.spark_partition_id().alias("split")).agg(size).orderBy("split").collect():
        n = -(-r.ids // length)
        found[r.split] = (base, n)
        base += n
    return found, base


def write_shards(docs: DataFrame, out: str, path: str, length: int = 1024, key: str = "epoch-0", end_id: int = 2, width: int = 2, shard_bytes: int = SHARD_BYTES) -> int:
    """Writes the shards of docs (doc_id, text; other columns are ignored) under `out`, as
    out/shards/shard=K/*.txt with out/manifest, and returns the number of sequences.

    docs must be a stored table, whose splits are the same in both passes; a split that has more
    sequences than its bytes allow fails. A null or empty text is the end id alone; a null doc_id
    is written as -1; repeated rows are written as often as they occur. Without rows nothing is
    written.
    """
    spark = docs.sparkSession
    splits, domain = room(docs, length)
    if not domain:
        return 0
    per_shard = max(1, shard_bytes // length)  # sequence numbers to a shard
    shards = -(-domain // per_shard)
    held = spark.sparkContext.broadcast(splits)
    kind = "<u2" if width == 2 else "<u4"

    def make(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base, most = held.value.get(TaskContext.get().partitionId(), (0, 0))
        perm, group, n = Permutation(domain, key), [], 0

        def flush():
            places = perm(np.arange(base + n - len(group), base + n))
            raw = np.zeros(len(group), [("head", HEAD), ("ids", kind, (length,))])
            for r, place, (doc_id, start, ids) in zip(raw, places.tolist(), group, strict=True):
                r["head"] = (doc_id, place, len(ids), start)
                r["ids"][: len(ids)] = ids
            data, size = pa.py_buffer(raw.tobytes()), raw.dtype.itemsize
            records = pa.Array.from_buffers(pa.binary(), len(group), [None, pa.py_buffer(np.arange(0, (len(group) + 1) * size, size, "<i4").tobytes()), data])
            return pa.RecordBatch.from_arrays([pa.array(places // per_shard, pa.int32()), pa.array(places, pa.int64()), records], names=["shard", "place", "record"])

        for sequence in _streams(batches, path, length, end_id):
            group.append(sequence)
            n += 1
            if n > most:
                raise RuntimeError(f"a split has over {most} sequences: its rows changed, or ids hold less than a byte")
            if len(group) == 1024:
                yield flush()
                group.clear()
        if group:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, "shard int, place long, record binary")
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place").select(F.col("record").cast("string"), "shard")
    rows.write.partitionBy("shard").option("lineSep", MARK.decode()).option("maxRecordsPerFile", 0).mode("overwrite").text(f"{out}/shards")
    size, files = stride(length, width), _files(spark, out).select("shard", "length").collect()  # a row a shard
    offset, manifest = 0, []
    for shard, n in sorted((r.shard, r.length) for r in files):
        if n % size or manifest and manifest[-1][0] == shard:
            raise RuntimeError(f"shard {shard} isn't one file of whole records")
        manifest.append((shard, offset, n // size, length, width, domain, key))
        offset += n // size
    names = "shard int, first_slot long, records long, length int, width int, domain long, key string"
    spark.createDataFrame(manifest, names).coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest")
    return offset


def _files(spark: SparkSession, out: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary, shard int"
    return spark.read.format("binaryFile").schema(schema).load(f"{out}/shards")


FOUND = "slot long, shard int, place long, doc_id long, start long, used long, ids binary"


def read_shards(spark: SparkSession, out: str, first_slot: int = 0) -> DataFrame:
    """slot, shard, place, doc_id, start, used, ids (bytes of the ids in use) of the records from
    first_slot on, by the manifest; shards before it aren't opened."""
    manifest = spark.read.parquet(f"{out}/manifest").where(F.col("first_slot") + F.col("records") > first_slot).collect()
    if not manifest:
        return spark.createDataFrame([], FOUND)
    length, width = manifest[0].length, manifest[0].width
    size, first = stride(length, width), {r.shard: r.first_slot for r in manifest}  # a number a shard

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                data = data.as_buffer()
                if len(data) % size:
                    raise ValueError(f"shard {shard}: {len(data)} bytes are no whole records")
                raw = np.frombuffer(data, np.uint8).reshape(-1, size)
                if raw[:, -len(MARK) :].tobytes() != MARK * len(raw):
                    raise ValueError(f"shard {shard}: a record has no end mark")
                head = np.frombuffer(raw[:, : HEAD.itemsize].tobytes(), HEAD)
                if (np.diff(head["place"]) <= 0).any():
                    raise ValueError(f"shard {shard}: records are out of order")
                ids = [r[HEAD.itemsize : HEAD.itemsize + width * int(u)].tobytes() for r, u in zip(raw, head["used"], strict=True)]
                cols = [first[shard] + np.arange(len(raw)), np.full(len(raw), shard, np.int32), *(head[c].astype(np.int64) for c in ("place", "doc_id", "start", "used"))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(ids, pa.binary())], names=["slot", "shard", "place", "doc_id", "start", "used", "ids"])

    files = _files(spark, out).where(F.col("shard") >= min(first))
    return files.select("shard", "content").mapInArrow(parse, FOUND).where(F.col("slot") >= first_slot)

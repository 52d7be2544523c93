"""What the training-data operators share: shared storage, gapless numbering, text kernels."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a fresh
    temporary one if driver and executors are one process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillspark-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


class Scratch:
    """Tables written once to the shared folder and read again, so that lineage is cut and
    a lost executor costs only the tasks that it was running."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/quillspark-{uuid.uuid4().hex}"
        self.n = 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/t{self.n}"

    def keep(self, df: DataFrame) -> DataFrame:
        p = self.path()
        df.write.parquet(p)
        out = self.spark.read.schema(df.schema).parquet(p)
        out._scratch_path = p
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that nothing unwritten still reads."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BITMAP_BITS = 26


def bitmap_parts(ids: DataFrame) -> DataFrame:
    """A bitmap of 2^26 bits over the upper bits of the hashes `id` (long), put together on the
    executors: rows (part, bits), at most 2,048 of 4 KB, whatever the input."""
    bit = F.shiftrightunsigned(F.col("id"), 64 - BITMAP_BITS)
    return (
        ids.select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits"))
    )


def where_in_bitmap(df: DataFrame, name: str, parts: DataFrame, is_in: bool = True) -> DataFrame:
    """The rows of df whose hash `name` (long) has its bit set in bitmap_parts(), or the others; in
    the JVM, by a broadcast of the parts."""
    place = F.shiftrightunsigned(F.col(name), 64 - BITMAP_BITS) + 1
    parts = parts.select(F.col("part").alias("_qs_part"), F.col("bits").alias("_qs_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_qs_bits", (at / 8).cast("int") + 1, 1)), 16, 10).cast("long")
    is_set = F.coalesce(F.getbit(byte, (at % 8).cast("int")), F.lit(0)) == 1
    found = df.join(F.broadcast(parts), F.bitmap_bucket_number(place) == F.col("_qs_part"), "left")
    return found.where(is_set if is_in else ~is_set).select(df.columns)


def bitmap(ids: DataFrame) -> bytes:
    """bitmap_parts() in one piece: 8 MB whatever the input."""
    parts = bitmap_parts(ids)
    out = bytearray(1 << (BITMAP_BITS - 3))
    for r in parts.collect():  # at most 2,048 rows of 4 KB
        at = (r.part - 1) * len(r.bits)
        out[at : at + len(r.bits)] = r.bits
    return bytes(out)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """The bits of 64-bit hashes in a bitmap()."""
    return hashes.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)


def in_bitmap(bits: Broadcast):
    """A column function: whether the bit of a hash (long) is set in a broadcast bitmap()."""

    @F.arrow_udf("boolean")
    def held(hashes: pa.Array) -> pa.Array:
        bit = bits_of(hashes.to_numpy(zero_copy_only=False).astype(np.int64))
        have = np.frombuffer(bits.value, np.uint8)[bit >> np.uint64(3)]
        return pa.array((have >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0)

    return held


PORTION = 4 << 20  # bytes of Arrow data that are worked on at once


def release() -> None:
    """Gives free memory of this process back to the system. Workers live on between tasks, and
    would hold the most that any of them took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def by_portion(start, limit: int = PORTION):
    """A function for mapInArrow. start() is called once a task and returns what turns a batch into
    a batch; this gets each batch in runs of rows of `limit` bytes on average. So a worker holds one
    batch and copies of a portion, and no more than its models between batches."""

    def run(batches):
        work = start()
        for batch in batches:
            step = max(1, batch.num_rows * limit // max(limit, batch.nbytes))
            for i in range(0, batch.num_rows, step):
                yield work(batch.slice(i, step))
            del batch  # else it is held while the next one is read
            release()

    return run


LOCAL_BITS = 33  # monotonically_increasing_id: the row's place in its partition


def gapless(scratch: Scratch, df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds a long column numbering the rows 0, 1, ... in the given order.

    A range partitioning deals the rows out (it splits runs of equal leading keys by the
    later ones), each partition numbers its own, and the offsets are a table of one row
    per partition, which bounds the broadcast.
    """
    kept = scratch.keep(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    )
    pid = F.shiftright("_mid", LOCAL_BITS)
    sizes = kept.groupBy(pid.alias("_pid")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        kept.withColumn("_pid", pid)
        .join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1)))
        .drop("_pid", "_off", "_mid")
    )


# ---------------------------------------------------------------- text kernels (numpy)

_U = np.uint64
_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 2**64 - 1, 256, dtype=_U)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: For word tokens: all ASCII that is neither letter nor digit separates.
NOT_WORD = np.ones(256, bool)
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = NOT_WORD[128:] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 20), base, _U)
        p[0] = 1
        have = _powers[base] = np.cumprod(p, dtype=_U)
    return have


def word_hashes(buf: np.ndarray, doc_starts: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts, and the text that each word is in.

    buf: the UTF-8 bytes of the texts one after the other; doc_starts: where each begins,
    and the end. A word's hash is a polynomial over a random value per byte, taken from
    prefix sums modulo 2^64.
    """
    n = len(buf)
    if not n:
        return np.empty(0, _U), np.empty(0, np.int64)
    sep = separators[buf]
    edge = np.zeros(n + 1, bool)
    edge[doc_starts] = True
    word = ~sep
    start = word.copy()
    start[1:] &= sep[:-1] | edge[1:n]
    end = word
    end[:-1] &= sep[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    prefix = np.zeros(n + 1, _U)
    np.cumsum(BYTE_VALUES[LOWER[buf]] * powers(BASE, n)[:n], out=prefix[1:])
    h = mix64((prefix[e] - prefix[s]) * powers(BASE_INV, n)[s] + (e - s).astype(_U))
    return h, np.searchsorted(doc_starts, s, "right") - 1


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words (fewer words: none)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.empty(0, _U)
    h = np.full(m, _U(k), _U)
    for i in range(k):
        h = h * _U(0xD6E8FEB86659FD93) + words[i : i + m]
    return mix64(h)


def byte_chunks(column, limit: int = 1 << 19):
    """Splits an Arrow string column (nulls become empty) into runs of texts of about
    `limit` bytes: yields (first row, bytes of the run, starts within them and the end).
    A longer text makes a run of its own."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j

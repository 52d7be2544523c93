"""Best-fit packing of token sequences with certified bin counts.

Documents become pieces; pieces that fill a sequence have one of their own. The others are
dealt into partitions of bounded size. Each partition packs its own by best-fit decreasing
and certifies the count by dual-feasible lower bounds: where count and bound are equal it is
proven optimal. Partitions with a gap release their least filled bins; the released documents
of several partitions meet and are packed again, unless a bound shows that this can't save a bin,
and the new bins replace the old ones only if they are fewer: the meeting is then a partition
like the others. Counts and bounds are taken anew after each round, and of all documents
together, until a bound is reached, nothing improves or the rounds are over.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PARTITION = 50_000  # pieces that a partition packs
RELEASE = 256  # bins that a partition with a gap releases at most
MEET = 16  # partitions whose released documents meet


def lower_bound(sizes: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """The best of several dual-feasible functions on integer sizes in 1..capacity, each of which
    stands for so many.

    The identity; for each a <= capacity/2 the function that counts sizes over capacity - a as
    a full bin and those under a as nothing; and the rounding functions
    x -> floor((k+1) x / capacity) / k (x itself where the quotient is whole).
    """
    if not len(sizes):
        return 0
    n = np.zeros(capacity + 1, np.int64)
    np.add.at(n, sizes, 1 if times is None else times)
    count, mass = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    best = -(-int(mass[-1]) // capacity)
    a = np.arange(1, capacity // 2 + 1)
    large = count[-1] - count[capacity - a]
    best = max(best, int((large + -(-(mass[capacity - a] - mass[a - 1]) // capacity)).max()))
    x = np.arange(capacity + 1)
    for k in range(1, 21):
        scaled = (k + 1) * x
        # in units of 1 / (k * capacity), to stay in whole numbers
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each size, and the number of bins. Open bins are kept by their room,
    with a bit set of the rooms that occur, so that the tightest one is found at once."""
    order = np.argsort(-sizes, kind="stable")
    bins, offs = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, used
            used += 1
        bins[i], offs[i] = b, capacity - room
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offs, used


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece. Longer documents are cut from
    the end, so only the first piece may be shorter than the capacity."""

    def start():
        import pyarrow as pa

        from .bpe import encoder

        enc = encoder(path)
        last = np.array([end_id], "<u4").tobytes()

        def make(batch):
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = enc.ids(text.as_py() or "") + last
                n = len(ids) // 4
                head = n % capacity or capacity
                cuts = [0, *range(head, n + 1, capacity)]
                for j, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(i)
                    piece.append(j)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[4 * s : 4 * e]))
            cols = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

        return make

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        C.by_portion(start), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


PACKED = "row long, part long, length long, bin long, offset long"


def pack_partition(capacity: int):
    """For applyInPandas: packs the pieces of one partition."""

    def pack(pdf):
        bins, offs, _ = best_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.assign(bin=bins, offset=offs)[["row", "part", "length", "bin", "offset"]]

    return pack


def meet_again(capacity: int):
    """For applyInPandas: packs released pieces of several partitions; they become the meeting's
    if that takes fewer bins, else they stay as they are."""

    def pack(pdf):
        sizes, saved = pdf["length"].to_numpy(), 0
        old = len(pdf[["part", "bin"]].drop_duplicates())
        if lower_bound(sizes, capacity) < old:
            bins, offs, used = best_fit_decreasing(sizes, capacity)
            if used < old:
                pdf, saved = pdf.assign(part=pdf["meeting"], bin=bins, offset=offs), old - used
        return pdf.assign(saved=saved)[["row", "part", "length", "bin", "offset", "saved"]]

    return pack


def certify(state: DataFrame, capacity: int) -> DataFrame:
    """(part, bins, bound) of each partition: the bins it uses and the fewest that could do, from
    its counts by length, of which there are at most `capacity`."""

    def bound(batches):
        import pyarrow as pa

        for batch in batches:
            got = [lower_bound(np.array([x["length"] for x in h]), capacity, np.array([x["n"] for x in h])) for h in batch.column("h").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("bins"), pa.array(got, pa.int64())], names=["part", "bins", "bound"])

    bins = state.groupBy("part", "bin").agg(F.lit(1)).groupBy("part").agg(F.count("*").alias("bins"))
    lengths = state.groupBy("part", "length").agg(F.count("*").alias("n")).groupBy("part").agg(F.collect_list(F.struct("length", "n")).alias("h"))
    return bins.join(lengths, "part").mapInArrow(bound, "part long, bins long, bound long")


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, rounds: int = 3, partition: int = PARTITION) -> DataFrame:
    """Packs all documents (doc_id, text; other columns are ignored) into sequences of at most
    `capacity` tokens: ids by the tokenizer file, then `end_id`.

    Returns per piece: doc_id, piece (from 0), start, length, ids_crc32, sequence_id, offset,
    certified (boolean: the partition that packed it proved its number of bins optimal),
    sequences and sequences_bound (of the whole packing: how many it has, and a proven lower
    bound of how many any packing of these pieces has).
    A null or empty text is the single token end_id. Rows that repeat, or share a doc_id, are
    packed each for itself. Without rows there are no pieces.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    every = scratch.keep(pieces(docs, path, capacity, end_id).withColumn("row", F.monotonically_increasing_id()))
    loose = every.where(f"length < {capacity}")
    parts = max(1, -(-loose.count() // partition))
    dealt = loose.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part"))
    state = scratch.keep(dealt.groupBy("part").applyInPandas(pack_partition(capacity), PACKED))
    lengths = every.groupBy("length").count().collect()  # at most `capacity` rows
    sizes, times = (np.array([r[c] for r in lengths], np.int64) for c in ("length", "count"))
    least, full = lower_bound(sizes, capacity, times), int(times[sizes == capacity].sum())
    next_part = parts  # numbers of meetings follow those of the partitions
    for turn in range(rounds + 1):
        status = scratch.keep(certify(state, capacity))
        used, n_gaps = status.agg(F.coalesce(F.sum("bins"), F.lit(0)), F.count_if(F.expr("bins > bound"))).first()
        if turn == rounds or n_gaps < 2 or used + full == least:
            break
        # one row a partition; their order is only used to form meetings
        n_meetings = max(1, -(-n_gaps // MEET))
        meeting = F.pmod(F.xxhash64("part", F.lit(turn)), F.lit(n_meetings)) + next_part
        meetings = status.where("bins > bound").select("part", meeting.alias("meeting"))
        fills = state.join(meetings, "part").groupBy("part", "meeting", "bin").agg(F.sum("length").alias("fill"))
        fills = fills.where(f"fill < {capacity}").withColumn("nth", F.expr("row_number() over (partition by part order by fill, bin)"))
        released = state.join(fills.where(f"nth <= {RELEASE}").select("meeting", "part", "bin"), ["part", "bin"])
        again = scratch.keep(released.groupBy("meeting").applyInPandas(meet_again(capacity), f"{PACKED}, saved long"))
        moved = again.where("saved > 0").drop("saved")
        if not moved.limit(1).count():
            break
        state = scratch.keep(state.join(moved.select("row"), "row", "left_anti").unionByName(moved))
        next_part += n_meetings
    proved = status.select("part", (F.col("bins") == F.col("bound")).alias("certified"))
    seq = (F.shiftleft("part", 32) + F.col("bin")) * 2
    placed = state.join(proved, "part").select("row", seq.alias("sequence_id"), "offset", "certified")
    whole = every.where(f"length = {capacity}").withColumn("sequence_id", F.col("row") * 2 + 1).withColumn("offset", F.lit(0).cast("long")).withColumn("certified", F.lit(True))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified"]
    out = every.join(placed, "row").select(cols).unionByName(whole.select(cols))
    return out.withColumns({"sequences": F.lit(used + full).cast("long"), "sequences_bound": F.lit(least).cast("long")})

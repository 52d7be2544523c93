"""Near-duplicate documents by min-max hashing, with exact confirmation and components.

1. A pass over the texts makes, per document, the size and a 128-bit fingerprint of its
   shingle set and a min-max signature: under each of `permutations` hash functions both the
   minimum and the maximum are kept, so n permutations give 2n signature values. Bands of
   `rows` values make the bucket keys.
2. Documents with equal sets form a class, which gets a number; from here on only classes
   take part, so an id that stands on several different texts joins nothing.
3. Every member of a bucket is paired with the bucket's smallest class (a star, linear in the
   bucket), and pairs are confirmed on full shingle sets. Components follow by alternating
   large-star and small-star steps.
4. Buckets that still hold several components get the pairs between these: their members are
   cut into blocks, blocks are compared by compact signatures, and what may reach the
   threshold is confirmed on full sets in place. So no cap is set on a bucket, and no pairs
   leave a block but the edges that join its components.

Tables between the steps are written to the shared folder. Text never goes through a shuffle:
the sets of the documents that need confirming are made in a second pass, picked by a bitmap
of fixed size (8 MB; a false positive costs a needless set, nothing else). keep_one() picks the
rows that go by two such bitmaps, and joins only those that both hold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SKETCH_SCHEMA = "k1 long, k2 long, n_shingles long, f1 long, f2 long, keys array<long>, compact binary"
BLOCK = 2_048  # members of a block at most on average ...
BLOCK_BYTES = 16 << 20  # ... and bytes of their sets
CLASS = ["n_shingles", "f1", "f2"]


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer than k words the whole sequence is the only one."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(C.shingle_hashes(words, k if len(words) >= k else len(words)))


def doc_words(column):
    """Yields (row, word hashes) for each text of an Arrow string column."""
    for first, buf, starts in C.byte_chunks(column):
        words, doc = C.word_hashes(buf, starts, C.WHITE)
        cuts = np.searchsorted(doc, np.arange(len(starts)))
        for i in range(len(starts) - 1):
            yield first + i, words[cuts[i] : cuts[i + 1]]


def family(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(971)
    return rng.integers(0, 2**64 - 1, (2, permutations), dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min and max under each function, interleaved."""
    out = np.empty(2 * len(a), np.uint64)
    lo, hi = out[0::2], out[1::2]
    lo[:], hi[:] = np.uint64(2**64 - 1), np.uint64(0)
    for i in range(0, len(shingles), 4096):
        h = a[:, None] * shingles[None, i : i + 4096] + b[:, None]
        np.minimum(lo, h.min(axis=1), out=lo)
        np.maximum(hi, h.max(axis=1), out=hi)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    m = C.mix64(sig[: bands * rows]).reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(C.BASE)
    for j in range(rows):
        h = C.mix64(h ^ m[:, j]) + np.uint64(j)
    return h


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    both = C.mix64(shingles + np.uint64(1)), C.mix64(shingles ^ np.uint64(C.BASE))
    return tuple(int(x.sum(dtype=np.uint64).view(np.int64)) for x in both)


def row_keys() -> list:
    """Two hashes that stand for a row's id and text."""
    return [F.xxhash64(F.lit(i), F.col("doc_id").cast("long"), "text").alias(f"k{i}") for i in (1, 2)]


def sketches(docs: DataFrame, k: int, permutations: int, bands: int, rows: int) -> DataFrame:
    if bands * rows > 2 * permutations:
        raise ValueError("more band rows than signature values")

    def start():
        import pyarrow as pa

        a, b = family(permutations)

        def make(batch):
            n, f1, f2, keys, compact = [], [], [], [], []
            for _, words in doc_words(batch.column("text")):
                s = shingle_set(words, k)
                n.append(len(s))
                for f, x in zip((f1, f2), fingerprint(s), strict=True):
                    f.append(x)
                if len(s):
                    sig = signature(s, a, b)
                    keys.append(band_keys(sig, bands, rows).view(np.int64))
                    compact.append((C.mix64(sig) >> np.uint64(56)).astype(np.uint8).tobytes())
                else:
                    keys.append(None)
                    compact.append(None)
            cols = [*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(compact, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "k1", "k2", "n_shingles", "f1", "f2", "keys", "compact"])

        return make

    return docs.select(F.col("doc_id").cast("long"), "text", *row_keys()).mapInArrow(C.by_portion(start), f"doc_id long, {SKETCH_SCHEMA}")


def shingle_sets(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(id, hashes of the full set as bytes) of the classes (id, rep, n_shingles, f1, f2), from the
    rows whose doc_id is a representative's and whose own set is the class's."""
    bits = docs.sparkSession.sparkContext.broadcast(C.bitmap(classes.select(F.xxhash64("rep").alias("id"))))

    def start():
        import pyarrow as pa

        have = np.frombuffer(bits.value, np.uint8)

        def make(batch):
            bit = batch.column("bit").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((have[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0))
            sets = [shingle_set(words, k) for _, words in doc_words(batch.column("text"))]
            f = np.array([(len(s), *fingerprint(s)) for s in sets], np.int64).reshape(-1, 3)
            cols = [batch.column("rep"), *(pa.array(f[:, i]) for i in range(3)), pa.array([s.tobytes() for s in sets], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["rep", *CLASS, "hashes"])

        return make

    bit = F.shiftrightunsigned(F.xxhash64("rep"), 64 - C.BITMAP_BITS)
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("rep is not null").withColumn("bit", bit)
    found = rows.mapInArrow(C.by_portion(start), "rep long, n_shingles long, f1 long, f2 long, hashes binary")
    return found.join(classes, ["rep", *CLASS]).dropDuplicates(["id"]).select("id", "hashes")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int(np.count_nonzero(y[at] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, as edges (u, v)."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                ok[i] = alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
            kept = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["u", "v"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(judge, "u long, v long")


def components(scratch: C.Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each other id in an edge reaches.

    Alternating large-star and small-star steps; every step is an aggregation with partial
    sums and a join that adaptive execution can split, so a centre with many neighbours is
    no bottleneck, and edges stay on the executors.
    """
    now = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = scratch.keep(small)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if state == before:
            out = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            out._scratch_path = now._scratch_path
            return out
        before = state
    raise RuntimeError("components did not settle")


def block_edges(members: DataFrame, percent: int, values: int) -> DataFrame:
    """Edges (u, v) that join different components within a bucket, confirmed on full sets.

    members: key, band, id, n, component, keys, compact, hashes. Blocks of at most 2,048 members and
    16 MB of sets (or one longer set), on average, meet in (bucket, block, block) groups. A pair is looked at in the first band
    that it shares, if its sizes allow the similarity, its compact signatures agree to within
    eight standard deviations and nothing found in the group joins it yet; so a group gives
    fewer edges than it has members, however many pairs are alike.
    """
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(8 * F.col("n")) / BLOCK_BYTES), F.lit(1)).cast("int")
    sizes = members.groupBy("key").agg(blocks.alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    spread = dealt.withColumn("at", F.explode(others)).select("key", "at.i", "at.j", "block", "band", "id", "n", "component", "keys", "compact", "hashes")
    t = percent / 100
    floor = t - 8 * (t * (1 - t) / values) ** 0.5 - 1 / 256

    def compare(pdf):
        import pandas as pd

        i, j, band = pdf["i"].iloc[0], pdf["j"].iloc[0], pdf["band"].iloc[0]
        side, ids, n = (pdf[c].to_numpy() for c in ("block", "id", "n"))
        sig = np.stack([np.frombuffer(x, np.uint8) for x in pdf["compact"]])
        keys = np.stack(pdf["keys"].to_list())[:, :band]
        sets = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        root = np.unique(pdf["component"].to_numpy(), return_inverse=True)[1]  # relabelled on a union
        right = np.flatnonzero(side == j)
        out = []
        for x in np.flatnonzero(side == i):
            may = (root[right] != root[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))
            if i == j:
                may &= right > x
            at = right[may]
            at = at[(sig[at] == sig[x]).mean(axis=1) >= floor]
            at = at[~(keys[at] == keys[x]).any(axis=1)]
            for y in at:
                if root[y] != root[x] and alike(sets[x], sets[y], percent):
                    out.append((ids[x], ids[y]))
                    root[root == root[y]] = root[x]
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["u", "v"])

    return spread.groupBy("key", "i", "j").applyInPandas(compare, "u long, v long")


def resolve(docs: DataFrame, scratch: C.Scratch, k: int, percent: int, permutations: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: a row per document (doc_id, k1, k2 and its class), and all classes
    (n_shingles, f1, f2, rep; of linked ones component_id, and first: whether it is the class that
    stands for its component)."""
    per_doc = scratch.keep(sketches(docs, k, permutations, bands, rows))
    classes = scratch.keep(
        per_doc.where("n_shingles > 0 and doc_id is not null").groupBy(*CLASS).agg(F.min("doc_id").alias("rep"))
        .withColumn("id", F.monotonically_increasing_id())  # final once written
    )
    reps = scratch.keep(
        per_doc.join(classes.withColumnRenamed("rep", "doc_id"), [*CLASS, "doc_id"])  # with the id, as a class may hold most rows
        .dropDuplicates([*CLASS, "doc_id"])  # by the join's keys, so without a shuffle
        .select("id", F.col("n_shingles").alias("n"), "keys", "compact")
    )
    entries = reps.select("id", "n", F.posexplode("keys").alias("band", "key"))
    least = F.min(F.struct("id", "n"))
    buckets = entries.groupBy("key").agg(least["id"].alias("leader"), least["n"].alias("m"), F.max("id").alias("last"), F.count("*").alias("members"))
    buckets = scratch.keep(buckets.where("leader <> last").drop("last"))
    in_buckets = scratch.keep(entries.join(buckets, "key").select("key", "band", "id", "n", "leader", "m", "members"))
    stars = in_buckets.where(f"id <> leader and 100 * least(n, m) >= {percent} * greatest(n, m)")
    stars = scratch.keep(stars.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
    wanted = classes.join(in_buckets.select("id").distinct(), "id", "left_semi")
    sets = scratch.keep(shingle_sets(docs, wanted, k))
    edges = scratch.keep(confirm(stars, sets, percent))
    comp = components(scratch, edges)

    of = in_buckets.where("members > 2").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = of.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("band").alias("first"), F.count("*").alias("m"),
        F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("who"),
    ).where("lo <> hi")
    # of buckets with the same members the one of the first band stands for all
    mixed = mixed.groupBy("m", "who").agg(F.min_by("key", "first").alias("key")).select("key")
    members = scratch.keep(of.join(mixed, "key", "left_semi").select("key", "band", "id", "n", "component"))
    if members.limit(1).count():
        full = members.join(reps.select("id", "keys", "compact"), "id").join(sets, "id")
        found = scratch.keep(block_edges(full, percent, 2 * permutations))
        comp = components(scratch, edges.union(found))

    # a component is named by its smallest doc_id; of classes that share this id one stands for it
    linked = classes.join(comp.union(comp.select("component", "component").distinct()), "id")
    named = linked.groupBy("component").agg(F.min(F.struct("rep", "id")).alias("first"))
    linked = linked.join(named, "component").select(*CLASS, F.col("first.rep").alias("component_id"), (F.col("id") == F.col("first.id")).alias("first"))
    # stored, as adaptive execution splits a hot class only in a join of two plain exchanges
    named = scratch.keep(classes.select(*CLASS, "rep").join(linked, CLASS, "left"))
    for t in (classes, reps, buckets, in_buckets, stars, sets, edges, members, comp):
        scratch.drop(t)
    return per_doc.select("doc_id", "k1", "k2", *CLASS), named


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, permutations: int = 64, bands: int = 25, rows: int = 5
) -> DataFrame:
    """Components of near-duplicate documents.

    docs: doc_id, text; other columns are ignored. Texts are lower-cased (A-Z only) and cut
    into words at space and \\x09-\\x0D; a set holds the distinct windows of k words, or the
    whole sequence if it is shorter. Two documents are linked if
    100 * intersection >= percent * union. Returns one row per input row: doc_id,
    n_shingles, component_id (smallest doc_id reachable, itself included), kept
    (doc_id = component_id).

    A null or empty text, or one without words, has an empty set, links with nothing and is
    kept. Links are between texts: where rows with the same doc_id have different texts, each row
    gets the component of its own. A null doc_id stays null, links nothing by itself and is
    kept. Tables without rows give no rows. The chance that banding misses a pair just at the
    threshold is (1 - t^rows)^bands: 5e-5 at 0.80, 4e-7 at 0.85.
    """
    per_doc, classes = resolve(docs, C.Scratch(docs.sparkSession), k, percent, permutations, bands, rows)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep", "doc_id"))
    out = per_doc.join(classes, CLASS, "left").withColumn("component_id", component)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, permutations: int = 64, bands: int = 25, rows: int = 5) -> DataFrame:
    """docs with one row of each component of near_duplicates(), all columns kept.

    Of a component the row with its smallest doc_id stays; if several have it, one of them, so of
    rows that repeat one stays, and rows go by id and text, not by id alone. Rows without words
    or with a null doc_id all stay.
    """
    scratch = C.Scratch(docs.sparkSession)
    per_doc, classes = resolve(docs, scratch, k, percent, permutations, bands, rows)
    least = F.coalesce("component_id", "rep")
    found = per_doc.where("n_shingles > 0 and doc_id is not null").join(classes, CLASS)
    stays = (F.col("doc_id") == least) & F.coalesce("first", F.lit(True))
    found = found.groupBy("k1", "k2").agg(F.first(stays).alias("stays"), F.count("*").alias("n"))
    found = scratch.keep(found.where("n > 1 or not stays"))
    drops = found.where("not stays").select("k1", "k2")
    first = C.bitmap_parts(found.select(F.col("k1").alias("id")))
    spared = C.where_in_bitmap(per_doc.select("k1", "k2"), "k1", first).join(drops, ["k1", "k2"], "left_anti")
    first, second = scratch.keep(first), scratch.keep(C.bitmap_parts(spared.select(F.col("k2").alias("id"))))
    keyed = docs.withColumns({f"_qs_k{i}": c for i, c in enumerate(row_keys(), 1)})
    out = C.where_in_bitmap(keyed, "_qs_k1", first, False).select(docs.columns)
    # in the first bitmap only: dropped; in both: for a join to tell, few rows unless many repeat
    doubt = C.where_in_bitmap(C.where_in_bitmap(keyed, "_qs_k1", first), "_qs_k2", second)
    renamed = found.select(F.col("k1").alias("_qs_k1"), F.col("k2").alias("_qs_k2"), "stays")
    out = out.unionByName(doubt.join(renamed.drop("stays"), ["_qs_k1", "_qs_k2"], "left_anti").select(docs.columns))
    if found.where("stays").limit(1).count():  # rows that repeat
        again = doubt.join(renamed.where("stays").drop("stays"), ["_qs_k1", "_qs_k2"], "left_semi")
        out = out.unionByName(again.dropDuplicates(["_qs_k1", "_qs_k2"]).select(docs.columns))
    return out

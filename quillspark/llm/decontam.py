"""Benchmark decontamination by greedy string tiling.

Shared seeds (runs of `match` equal word hashes) join documents and passages, and every
(document, passage) pair that may reach the threshold is tiled: running Karp-Rabin with a falling
search length finds maximal matches, the longest are marked first, and marked words take no
part again. A passage that the tiles cover to the threshold is leaked, in whatever order its
parts stand. A passage of fewer than `match` words is leaked by a text of just these words.

A benchmark of at most 8 MB of text is broadcast and texts are read once, without a shuffle. A
larger one is joined: a bitmap of its seeds (8 MB, whatever their number) picks the runs of each
text that may match, and only their seeds and words are shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MATCH = 5  # words of the shortest tile
COVERAGE = 0.5  # share of a passage's words in tiles
BLOCK_BYTES = 8 << 20  # benchmark text that is broadcast at most
SALT = 16  # parts of a seed or passage that many documents share


def tile(item: list, text: list, match: int, search: int = 20) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: (place in item, place in text, length) of the
    tiles. Words that equal None never match."""
    a_marked, b_marked, tiles = [False] * len(item), [x is None for x in text], []
    mask, base = (1 << 61) - 1, 1_000_003

    def windows(seq, marked, s):
        """(start, hash) of every unmarked window, by a rolling hash."""
        lead, h, run = pow(base, s - 1, mask), 0, 0
        for i, x in enumerate(seq):
            if marked[i]:
                h = run = 0
                continue
            if run >= s:
                h = (h - seq[i - s] * lead) % mask
            h = (h * base + x) % mask
            run += 1
            if run >= s:
                yield i - s + 1, h

    def scan(s):
        """The maximal matches of s or more; or the length of one of 2 s or more, to begin with."""
        table, found = {}, []
        for p, h in windows(item, a_marked, s):
            table.setdefault(h, []).append(p)
        for q, h in windows(text, b_marked, s):
            for p in table.get(h, ()):
                n = 0
                while p + n < len(item) and q + n < len(text) and item[p + n] == text[q + n] and not a_marked[p + n] and not b_marked[q + n]:
                    n += 1
                if n > 2 * s:
                    return n, []
                if n >= s:
                    found.append((n, p, q))
        return 0, found

    s = max(search, match)
    while True:
        longer, found = scan(s)
        if longer:
            s = longer
            continue
        again = False
        for n, p, q in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if any(a_marked[p : p + n]) or any(b_marked[q : q + n]):
                again = True  # what is left of it may still be long enough
                continue
            a_marked[p : p + n] = b_marked[q : q + n] = [True] * n
            tiles.append((p, q, n))
        if again and found:
            continue
        if s <= match:
            return tiles
        s = s // 2 if s > 2 * match else match


def near_words(words: np.ndarray, starts: list[int], match: int) -> list:
    """The words within seeds at the given places, in order, with None between runs."""
    reach = np.zeros(len(words) + 1, bool)  # only words of a seed can be in a tile
    for p in starts:
        reach[p : p + match] = True
    near, last = [], -1
    for p in np.flatnonzero(reach[:-1]).tolist():
        if p != last + 1:
            near.append(None)
        near.append(int(words[p]))
        last = p
    return near


def judge(item: list, grams: np.ndarray, seeds: np.ndarray, near: list, match: int, coverage: float):
    """(tiles, covered words) if a passage is leaked, else None. grams: its seeds by place; seeds,
    near: those that the text shares, and its words there."""
    shared = np.flatnonzero(np.isin(grams, seeds))[:, None] + np.arange(match)
    if len(np.unique(shared)) < coverage * len(item):
        return None  # all words of a tile are in shared seeds
    tiles = tile(item, near, match)
    covered = sum(n for _, _, n in tiles)
    return (len(tiles), covered) if covered >= coverage * len(item) else None


class Passages:
    """The seeds of benchmark passages, and those passages that are too short to have any."""

    def __init__(self, rows: list[tuple[int, str]], match: int):
        self.ids, self.words, self.grams, self.match, self.short = [], [], [], match, {}
        seeds, owner = [], []
        for item_id, text in rows:
            buf = np.frombuffer((text or "").encode(), np.uint8)
            words, _ = C.word_hashes(buf, np.array([0, len(buf)]), C.NOT_WORD)
            if len(words) < match:
                self.short.setdefault(words.tobytes(), []).append((item_id, len(words)))
                continue
            seeds.append(C.shingle_hashes(words, match))
            owner.append(np.full(len(seeds[-1]), len(self.ids)))
            self.ids.append(item_id)
            self.words.append(words)
            self.grams.append(seeds[-1])
        h = np.concatenate([np.empty(0, np.uint64), *seeds])
        o = np.concatenate([np.empty(0, np.int64), *owner])
        order = np.argsort(h, kind="stable")
        self.seeds, self.owner = h[order], o[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.seeds >> np.uint64(44)] = True

    def leaks(self, words: np.ndarray, coverage: float):
        """(item_id, tiles, covered words, words) of the passages that a text leaks."""
        if 0 < len(words) < self.match:
            yield from ((i, 1, n, n) for i, n in self.short.get(words.tobytes(), ()))
        h = C.shingle_hashes(words, self.match)
        at = np.flatnonzero(self.sieve[h >> np.uint64(44)])
        if not len(at):
            return
        lo, hi = np.searchsorted(self.seeds, h[at], "left"), np.searchsorted(self.seeds, h[at], "right")
        places: dict[int, list[int]] = {}
        for p, s, e in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            for o in set(self.owner[s:e].tolist()):
                places.setdefault(o, []).append(p)
        for o, starts in places.items():
            found = judge(self.words[o].tolist(), self.grams[o], h[starts], near_words(words, starts, self.match), self.match, coverage)
            if found:
                yield self.ids[o], *found, len(self.words[o])


def texts_words(column):
    """Yields (row, word hashes) of each text: ASCII letters lower-cased; ASCII signs separate."""
    for first, buf, starts in C.byte_chunks(column):
        words, doc = C.word_hashes(buf, starts, C.NOT_WORD)
        cuts = np.searchsorted(doc, np.arange(len(starts)))
        for i in range(len(starts) - 1):
            yield first + i, words[cuts[i] : cuts[i + 1]]


LEAKS = "doc_id long, item_id long, tiles long, covered long, item_words long, coverage double"


def _small(benchmark: DataFrame) -> list[tuple[int, str]] | None:
    """The passages, if their text is at most BLOCK_BYTES, and at most an eighth as many."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    if (size or 0) > BLOCK_BYTES or n > BLOCK_BYTES // 8:
        return None
    return [tuple(r) for r in rows.collect()]


def _leak_batch(batch, at: list, rows: list):
    import pyarrow as pa

    cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
    share = pa.array([r[2] / r[3] for r in rows], pa.float64())
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *cols, share], names=["doc_id", "item_id", "tiles", "covered", "item_words", "coverage"])


def leaks(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """One row per (document, passage) leaked: doc_id, item_id, tiles, covered, item_words,
    coverage. docs: doc_id, text; benchmark: item_id, text; other columns are ignored.

    Documents without a leak have no row. Null and empty texts leak nothing; null passages and
    those without words can't be leaked; one of fewer than `match` words is leaked by documents of
    just these words. A repeated row gives its rows again. Empty tables give no rows.
    """
    rows = _small(benchmark)
    if rows is None:
        return _joined(docs, benchmark, match, coverage).select(*[c.split()[0] for c in LEAKS.split(", ")])
    held = docs.sparkSession.sparkContext.broadcast(rows)

    def find(batches):
        passages = Passages(held.value, match)
        for batch in batches:
            found = [(i, x) for i, words in texts_words(batch.column("text")) for x in passages.leaks(words, coverage)]
            yield _leak_batch(batch, [i for i, _ in found], [x for _, x in found])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, LEAKS)


def _keys() -> list:
    return [F.xxhash64(F.lit(i), F.col("doc_id").cast("long"), "text").alias(f"_qs_k{i}") for i in (1, 2)]


def _joined(docs: DataFrame, benchmark: DataFrame, match: int, coverage: float) -> DataFrame:
    """leaks() for a benchmark of any size, with the keys of the rows."""
    scratch = C.Scratch(docs.sparkSession)
    seeds_of = lambda w: C.shingle_hashes(w, match) if len(w) >= match else C.shingle_hashes(w, len(w)) if len(w) else C.shingle_hashes(w, 1)

    def passages(batches):
        import pyarrow as pa

        for batch in batches:
            words = [w for _, w in texts_words(batch.column("text"))]
            lists = [pa.array([x.view(np.int64) for x in xs], pa.list_(pa.int64())) for xs in (words, [seeds_of(w) for w in words])]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), *lists], names=["item_id", "words", "grams"])

    items = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(passages, "item_id long, words array<long>, grams array<long>")
    items = scratch.keep(items.where("size(words) > 0").withColumn("item", F.monotonically_increasing_id()))
    bits = docs.sparkSession.sparkContext.broadcast(C.bitmap(items.select(F.explode("grams").alias("id"))))

    def runs(batches):
        import pyarrow as pa

        have = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little")
        for batch in batches:
            at, seeds, near, short = [], [], [], []
            for i, words in texts_words(batch.column("text")):
                h = seeds_of(words)
                hit = np.flatnonzero(have[C.bits_of(h)])
                if len(hit):
                    at.append(i)
                    seeds.append(np.unique(h[hit]).view(np.int64))
                    w = min(match, len(words))
                    near.append([None if x is None else int(np.uint64(x).astype(np.int64)) for x in near_words(words, hit.tolist(), w)])
                    short.append(len(words) < match)
            rows = pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "_qs_k1", "_qs_k2")], names=["doc_id", "_qs_k1", "_qs_k2"]).take(pa.array(at, pa.int64()))
            cols = [pa.array(x, pa.list_(pa.int64())) for x in (seeds, near)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *cols, pa.array(short, pa.bool_())], names=["doc_id", "_qs_k1", "_qs_k2", "seeds", "near", "short"])

    found = docs.select(F.col("doc_id").cast("long"), "text", *_keys()).mapInArrow(runs, "doc_id long, _qs_k1 long, _qs_k2 long, seeds array<long>, near array<long>, short boolean")
    found = scratch.keep(found.withColumn("row", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    grams = items.select("item", F.size("words").alias("n"), F.explode("grams").alias("seed")).groupBy("item", "n", "seed").agg(F.count("*").alias("places"))
    shared = found.select("row", "salt", "short", F.explode("seeds").alias("seed")).join(grams.select("*", salts), ["seed", "salt"])
    # short passages go with short texts only; a seed covers at most `match` words a place
    pairs = shared.where(f"short = (n < {match})").groupBy("row", "salt", "item", "n").agg(F.sum("places").alias("places"))
    pairs = scratch.keep(pairs.where(f"places * {match} >= {coverage} * n").select("row", "salt", "item"))
    joined = pairs.join(items.select("*", salts), ["item", "salt"]).join(found.drop("salt"), "row")

    def tile_pairs(batches):
        for batch in batches:
            at, rows = [], []
            for i, r in enumerate(batch.select(["item_id", "words", "grams", "seeds", "near", "short"]).to_pylist()):
                words = r["words"]
                got = (1, len(words)) if r["short"] and r["near"] == words else None
                if not r["short"]:
                    plain = lambda x: None if x is None else x % (1 << 64)
                    got = judge([plain(x) for x in words], np.array(r["grams"]), np.array(r["seeds"]), [plain(x) for x in r["near"]], match, coverage)
                if got:
                    at.append(i)
                    rows.append((r["item_id"], *got, len(words)))
            out = _leak_batch(batch, at, rows)
            import pyarrow as pa

            for c in ("_qs_k1", "_qs_k2"):
                out = out.append_column(c, batch.column(c).take(pa.array(at, pa.int64())))
            yield out

    cols = ["doc_id", "_qs_k1", "_qs_k2", "item_id", "words", "grams", "seeds", "near", "short"]
    return joined.select(cols).mapInArrow(tile_pairs, LEAKS + ", _qs_k1 long, _qs_k2 long")


def clean(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The documents that leak no passage, with all their columns; see leaks(). Null and empty texts
    stay; rows that repeat are treated alike; columns of any other name pass through."""
    rows = _small(benchmark)
    if rows is None:
        gone = _joined(docs, benchmark, match, coverage).select("_qs_k1", "_qs_k2").distinct()
        return docs.select("*", *_keys()).join(gone, ["_qs_k1", "_qs_k2"], "left_anti").select(docs.columns)
    held = docs.sparkSession.sparkContext.broadcast(rows)

    def start():
        import pyarrow as pa

        passages = Passages(held.value, match)

        def keep(batch):
            ok = [next(passages.leaks(words, coverage), None) is None for _, words in texts_words(batch.column("text"))]
            return batch.filter(pa.array(ok, pa.bool_()))

        return keep

    return docs.mapInArrow(C.by_portion(start), docs.schema)

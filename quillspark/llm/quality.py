"""Document quality by Bradley-Terry pairwise ranking.

Preference pairs (a document labelled good over one labelled bad) train a logistic loss on
the difference of their features; a document's score is its strength. The threshold is the
quantile of the training strengths at the share of bad labels, and strengths are mapped to
0..1 so that it lies at 0.3. Features are counted over whole texts. fit() learns bins, weights
and threshold from every labelled row and all pairs, by sums over the rows where they are; only
vectors of fixed length come to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PAIRS = 20_000  # preference pairs of a Model of rows in memory; fit() takes all pairs
BINS = 8
CUT = 0.3
RIDGE = 1e-3
REACH, GRID = 64, 64  # strengths of opponents: to 64 either way, by 64ths
POINTS = np.arange(2 * REACH * GRID + 1) / GRID - REACH
PIECE = 4_096  # numbers of a vector that are added up in one place

_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
CLASS = np.zeros(256, np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[32], CLASS[10] = 1, 2, 3, 4, 5
CLASS[128:192], CLASS[192:] = 6, 7
CLASS[_SIGNS] = np.arange(8, 8 + len(_SIGNS))
N_CLASS = 8 + len(_SIGNS)
NAMES = 11 + N_CLASS


def features(column) -> np.ndarray:
    """A row of features for each text of an Arrow string column."""
    out = np.zeros((len(column), NAMES))
    for first, buf, starts in C.byte_chunks(column):
        n = len(starts) - 1
        doc = np.repeat(np.arange(n), np.diff(starts))
        cls = CLASS[buf]
        counts = np.bincount(doc * N_CLASS + cls, minlength=n * N_CLASS).reshape(n, N_CLASS).astype(float)
        chars = np.maximum(counts.sum(1) - counts[:, 6], 1)
        words, of = C.word_hashes(buf, starts, C.WHITE)
        cuts = np.searchsorted(of, np.arange(n + 1))
        f = out[first : first + n]
        f[:, :N_CLASS] = np.sqrt(counts / chars[:, None])
        w = np.diff(cuts)
        letters = counts[:, 1] + counts[:, 2] + counts[:, 7]
        f[:, N_CLASS] = np.log1p(counts.sum(1))
        f[:, N_CLASS + 1] = np.log1p(w)
        f[:, N_CLASS + 2] = chars / np.maximum(w, 1)
        f[:, N_CLASS + 3] = np.log1p(counts[:, 5])
        f[:, N_CLASS + 4] = counts[:, 8:].sum(1) / chars
        f[:, N_CLASS + 5] = counts[:, 2] / np.maximum(letters, 1)
        for i in range(n):
            x = words[cuts[i] : cuts[i + 1]]
            if not len(x):
                continue
            _, times = np.unique(x, return_counts=True)
            f[i, N_CLASS + 6] = len(times) / len(x)
            f[i, N_CLASS + 7] = times.max() / len(x)
            f[i, N_CLASS + 8] = (times == 1).sum() / len(x)
            grams = C.shingle_hashes(x, 3)
            f[i, N_CLASS + 9] = len(np.unique(grams)) / max(1, len(grams))
            data = bytes(buf[starts[i] : starts[i + 1]]).split(b"\n")
            f[i, N_CLASS + 10] = len(set(data)) / len(data)
    return out


class Model:
    """Bins of the features at training quantiles, a weight for each, and the map to 0..1."""

    def __init__(self, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 5):
        self.edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0) if len(x) else np.zeros((BINS - 1, NAMES))
        self.mean, self.std = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(NAMES), np.ones(NAMES))
        g, b = np.flatnonzero(good), np.flatnonzero(~good)
        self.weights, self.scale, self.cut = np.zeros(NAMES * (BINS + 1)), 1.0, 0.0
        if not len(g) or not len(b):
            return  # nothing to prefer: all strengths are 0
        z = self.design(x)
        rng = np.random.default_rng(seed)
        m = max(pairs, len(x))
        d = (z[rng.choice(g, m)] - z[rng.choice(b, m)]).astype(np.float32)
        w = np.zeros(d.shape[1], np.float32)
        for _ in range(12):  # Newton steps on the mean logistic loss with a ridge
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad = -(d.T @ p) / m + 1e-3 * w
            hess = (d * (p * (1 - p))[:, None]).T @ d / m + 1e-3 * np.eye(len(w), dtype=np.float32)
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-3:
                break
        self.weights = w.astype(float)
        s = z @ self.weights
        self.cut = float(np.quantile(s, len(b) / len(x)))
        self.scale = 1.0 / max(float(s.std()), 1e-9)

    def design(self, x: np.ndarray) -> np.ndarray:
        which = (x[:, None, :] > self.edges[None]).sum(1)
        z = np.zeros((len(x), NAMES, BINS + 1), np.float32)
        np.put_along_axis(z, which[:, :, None], 1.0, 2)
        z[:, :, BINS] = np.clip((x - self.mean) / self.std, -4, 4)
        return z.reshape(len(x), -1)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for i in range(0, len(x), 2048):
            s = (self.design(x[i : i + 2048]) @ self.weights - self.cut) * self.scale
            out[i : i + 2048] = 1 / (1 + np.exp(-np.clip(2 * s + np.log(CUT / (1 - CUT)), -30, 30)))
        return out


def _features_of(docs: DataFrame) -> DataFrame:
    def make(batches):
        import pyarrow as pa

        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, x binary")


def _sums(rows: DataFrame, part) -> np.ndarray:
    """The sum of the vectors part(good, x) over all rows (y, x), added up on the executors in
    pieces; without rows it is empty."""

    def make(batches):
        import pyarrow as pa

        total = 0.0
        for batch in batches:
            good = batch.column("y").to_numpy() == 1
            x = np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(-1, NAMES)
            for i in range(0, len(x), 2048):
                total = total + part(good[i : i + 2048], x[i : i + 2048])
        if isinstance(total, np.ndarray):
            v = [total[i : i + PIECE].tobytes() for i in range(0, len(total), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(v)), pa.int32()), pa.array(v, pa.binary())], names=["piece", "v"])

    def add(table):
        import pyarrow as pa

        v = sum(np.frombuffer(x) for x in table.column("v").to_pylist())
        return pa.table({"piece": table.column("piece").slice(0, 1), "v": pa.array([v.tobytes()], pa.binary())})

    found = rows.mapInArrow(make, "piece int, v binary").groupBy("piece").applyInArrow(add, "piece int, v binary").collect()
    return np.concatenate([np.empty(0), *(np.frombuffer(r["v"]) for r in sorted(found))])


def _octave_cells(x: np.ndarray, bits: int) -> np.ndarray:
    """Cells of numbers from 0, in their order: 2^bits to an octave, from 2^-20 to 2^17."""
    cell = np.clip(x, 0, 2.0**17).astype(np.float32).view(np.int32).astype(np.int64) >> (23 - bits)
    return np.maximum(cell - (107 << bits) + 1, 0)


def _bins(rows: DataFrame, model: Model) -> tuple[int, int]:
    """Sets the edges (order statistics to 2^-16 of their size), mean and std of the features of
    all rows; returns the numbers of good and bad rows."""
    n_cells = (37 << 8) + 2
    name = np.arange(NAMES)

    def count(good, x):
        at = (name * n_cells + _octave_cells(x, 8)).ravel()
        return np.concatenate([[good.sum(), (~good).sum()], np.bincount(at, minlength=NAMES * n_cells)]).astype(float)

    got = _sums(rows, count)
    if not len(got):
        return 0, 0
    counts, n = got[2:].reshape(NAMES, n_cells), got[:2].sum()
    size = np.concatenate([[0.0], ((np.arange(1, n_cells) - 0.5) / 256 % 1 + 1) * 2.0 ** ((np.arange(1, n_cells) - 1) // 256 - 20)])
    model.mean = counts @ size / n
    model.std = np.sqrt(np.maximum(counts @ size**2 / n - model.mean**2, 0)) + 1e-9
    rank = np.floor((n - 1) * np.linspace(0, 1, BINS + 1)[1:-1])
    run = np.cumsum(counts, axis=1)
    first = np.stack([np.searchsorted(r, rank, "right") for r in run])  # the cell of each edge, by feature
    left = rank - np.take_along_axis(np.pad(run, ((0, 0), (1, 0))), first, 1)

    def refine(good, x):
        rough, fine = _octave_cells(x, 8), _octave_cells(x, 16)
        within = np.maximum(fine - ((rough - 1) << 8) - 1, 0)  # place in the rough cell
        out = np.zeros((NAMES, BINS - 1, 256))
        for e in range(BINS - 1):
            i, j = np.nonzero(rough == first[:, e])
            out[:, e] = np.bincount(j * 256 + np.minimum(within[i, j], 255), minlength=NAMES * 256).reshape(NAMES, 256)
        return out.ravel()

    run = np.cumsum(_sums(rows, refine).reshape(NAMES, BINS - 1, 256), axis=2)
    cell = ((first - 1) << 8) + 1 + (run <= left[:, :, None]).sum(2)
    upper = (((cell + (107 << 16)) << 7) - 1).astype(np.int32).view(np.float32).astype(float)
    model.edges = np.where(first > 0, upper, 0.0).T
    return int(got[0]), int(got[1])


def _steps(s: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((s + REACH) * GRID), 0, 2 * REACH * GRID).astype(np.int64)


def _strengths(rows: DataFrame, model: Model, low: float | None = None) -> np.ndarray:
    """How many bad (first) and good rows have which strength: on the whole grid, or on the 4,096 parts
    of the grid's step at `low` (rows outside are left out)."""

    def count(good, x):
        s = model.design(x) @ model.weights
        if low is None:
            return np.bincount(good * len(POINTS) + _steps(s), minlength=2 * len(POINTS)).astype(float)
        inside = _steps(s) == _steps(np.array(low))
        part = np.clip((s[inside] - low) * GRID * 4096 + 2048, 0, 4095).astype(np.int64)
        return np.bincount(good[inside] * 4096 + part, minlength=2 * 4096).astype(float)

    return _sums(rows, count).reshape(2, -1)


def _learn(rows: DataFrame, model: Model, n_good: int, n_bad: int) -> None:
    """Sets weights, scale and cut at the minimum of the mean logistic loss of all pairs of a good and a bad
    row, with a ridge. A row meets the strengths of all rows of the other label at once, on a
    grid of 1/64; second derivatives take them in 64 groups, which bears on the path alone."""
    pairs, of = float(n_good) * n_bad, np.triu_indices(NAMES * (BINS + 1))
    far = np.arange(-2 * REACH * GRID, 2 * REACH * GRID + 1) / GRID
    lose = 1 / (1 + np.exp(np.clip(far, -500, 500)))  # by strength of good less bad
    meet = lambda n, kernel: np.convolve(n, kernel, "valid")
    before, least = model.weights, np.inf
    for _ in range(30):
        bad, good = n = _strengths(rows, model)
        loss = good @ meet(bad, np.logaddexp(0, -far)) / pairs + 0.5 * RIDGE * model.weights @ model.weights
        if loss > least + 1e-9:  # too far
            model.weights = (model.weights + before) / 2
            continue
        before, least = model.weights, loss
        pull = np.stack([meet(good, lose[::-1]), -meet(bad, lose)]) / pairs  # of a bad row, of a good row
        group = np.minimum(64 * np.cumsum(n.sum(0)) / n.sum(), 63).astype(np.int64)
        sizes = np.stack([np.bincount(group, m, 64) for m in n])
        mean = np.stack([np.bincount(group, m * POINTS, 64) for m in n]) / np.maximum(sizes, 1)
        bend = np.exp(-np.logaddexp(0, d := mean[0][:, None] - mean[1]) - np.logaddexp(0, -d)) / pairs
        curve = np.stack([bend @ sizes[1], sizes[0] @ bend])

        def part(good, x, w=before, pull=pull, group=group, curve=curve):
            z, y = model.design(x), good.astype(np.int64)
            s = z @ w
            force = np.where(good, np.interp(s, POINTS, pull[1]), np.interp(s, POINTS, pull[0]))
            k = group[_steps(s)]
            each = (np.arange(128)[:, None] == y * 64 + k).astype(np.float32)
            second = (z * curve[y, k][:, None].astype(np.float32) * np.float32(pairs)).T @ z
            return np.concatenate([z.T @ force, second[of], (each @ z).ravel()], dtype=float)

        got = _sums(rows, part)
        width = len(before)
        grad, sums = got[:width] + RIDGE * before, got[width + len(of[0]) :].reshape(2, 64, width)
        hess = np.zeros((width, width))
        hess[of] = got[width : width + len(of[0])] / pairs
        cross = sums[0].T @ bend @ sums[1]
        hess = hess + np.triu(hess, 1).T - cross - cross.T + RIDGE * np.eye(width)
        step = np.linalg.solve(hess, grad)
        model.weights = before - step
        if np.abs(step).max() < 1e-3:
            break
    n = _strengths(rows, model).sum(0)
    total, mean = n.sum(), n @ POINTS / n.sum()
    model.scale = 1.0 / max(float(np.sqrt(n @ (POINTS - mean) ** 2 / total)), 1e-9)
    run = np.cumsum(n)

    def ranked(r):
        at = int(np.searchsorted(run, r, "right"))
        fine = np.cumsum(_strengths(rows, model, POINTS[at]).sum(0))
        return POINTS[at] + (np.searchsorted(fine, r - (run[at] - n[at]), "right") - 2047.5) / (GRID * 4096)

    x, y = ranked(n_bad - 1), ranked(n_bad)
    model.cut = float(x + (y - x) * (1 - n_bad / total))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from every labelled row. docs: doc_id, text; labels: doc_id, quality. Rows with a null
    id or label are left out; labels for no document teach nothing. Texts stay where they are:
    a bitmap of the labelled ids picks them, and only features meet labels."""
    spark, scratch = docs.sparkSession, C.Scratch(docs.sparkSession)
    labels = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y"))
    bits = spark.sparkContext.broadcast(C.bitmap(labels.select(F.xxhash64("doc_id").alias("id"))))
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    picked = docs.where(C.in_bitmap(bits)(F.xxhash64("doc_id")))
    rows = scratch.keep(_features_of(picked).join(labels, "doc_id").select("y", "x"))
    model = Model(np.empty((0, NAMES)), np.empty(0, bool))
    n_good, n_bad = _bins(rows, model)
    if n_good and n_bad:  # else nothing to prefer: all strengths are 0
        _learn(rows, model, n_good, n_bad)
    scratch.drop(rows)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted (score >= 0.3) of every document (doc_id, text; other columns
    are ignored). Null and empty texts are scored on features of nothing. Repeated rows get
    equal scores."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            s = held.value.score(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))

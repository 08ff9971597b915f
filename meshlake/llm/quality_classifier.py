"""Quality classifier: ridge regression on random Fourier features of document statistics.

The features approximate a Gaussian kernel; each task sums the normal equations of its rows and the
sums meet in a tree. Raw scores are calibrated by isotonic regression on labelled rows. Statistics come
from the text alone; doc_id, labels, language and source are never inputs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, filter_texts, parts
from .textnum import release, windows, word_hashes

#: Random features, kernel width in standard deviations, ridge, seed, bins of raw scores for calibration.
FEATURES, WIDTH, RIDGE, SEED, BINS = 192, 3.0, 1.0, 7, 2000
THRESHOLD = 0.3

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "newline": (10,), "bang": b"!?", "stop": b".,;:",
    "symbol": b"#*$%&|<>", "other": b"\"'()-/+=@[]\\^_`{}~", "wide": range(128, 256),
}
STATS = ("log_words", "log_bytes", *_CLASSES, "word_mean", "word_sd", "distinct", "repeat5", "lines", "dup_lines", "longest")


def _class_table() -> np.ndarray:
    out = np.full(256, len(_CLASSES), np.uint8)
    for i, members in enumerate(_CLASSES.values()):
        out[list(members)] = i
    return out


def text_stats(texts: list[str]) -> np.ndarray:
    """A row of ``STATS`` for each whole text; zeros for an empty one."""
    data = [t.encode() for t in texts]
    out, table, k = np.zeros((len(data), len(STATS))), _class_table(), len(_CLASSES)
    for first, h, cut, s, e in word_hashes(data):
        length, five = (e - s).astype(float), windows(h, 5)
        for j in range(len(cut) - 1):
            i, a, z = first + j, cut[j], cut[j + 1]
            raw, n = data[i], int(z - a)
            if not raw:
                continue
            share = np.bincount(table[np.frombuffer(raw, np.uint8)], minlength=k + 1)[:k] / len(raw)
            out[i, :2] = math.log1p(n), math.log1p(len(raw))
            out[i, 2 : 2 + k] = np.sqrt(share)  # small shares count too
            if n:
                w = length[a:z]
                out[i, 2 + k : 5 + k] = math.log1p(w.mean()), math.log1p(w.std()), len(np.unique(h[a:z])) / n
                if n > 5:
                    g = five[a : z - 4]
                    out[i, 5 + k] = 1 - len(np.unique(g)) / len(g)
                lines = [x for x in raw.split(b"\n") if x.strip()]
                out[i, 6 + k] = math.log1p(n / max(1, len(lines)))
                out[i, 7 + k] = 1 - len(set(lines)) / max(1, len(lines))
                out[i, 8 + k] = math.log1p(w.max())
    return out


def with_stats(docs: DataFrame) -> DataFrame:
    """``doc_id, stats``; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                stats = text_stats([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(stats.astype(np.float64)), pa.list_(pa.float64()))], names=["doc_id", "stats"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, stats array<double>")


def _matrix(column) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), len(STATS))


def _summed(df: DataFrame, column: str, fold) -> bytes | None:
    """Sums binary rows of float64 in a tree: each step's tasks meet in the square root of their number.
    The driver receives one row."""

    def run(batches):
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                a = np.frombuffer(x)
                total = a.copy() if total is None else total + a
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

    middle = max(1, math.isqrt(parts(df.sparkSession)))
    out = df.mapInArrow(fold, "x binary").repartition(middle).mapInArrow(run, "x binary").coalesce(1).mapInArrow(run, "x binary").collect()
    return bytes(out[0].x) if out else None


class KernelModel:
    """Scale, random directions, ridge weights and the calibration's steps; of fixed size."""

    def __init__(self, mean, scale):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / WIDTH, (len(STATS), FEATURES))
        self.b = rng.uniform(0, 2 * math.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.at, self.value = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(x @ self.w + self.b) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.beta, -0.5, 1.5)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.at, self.value), 0, 1)


def isotonic(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in ascending order: block centres and their non-decreasing means."""
    blocks: list[list[float]] = []
    for c, s, k in zip(x, total, n):
        blocks.append([c * k, s, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(labelled: DataFrame) -> KernelModel:
    """``labelled``: ``stats, quality``. Without rows every score is 0.5; with one class, that class."""

    def moments(batches):
        total = np.zeros(2 * len(STATS) + 2)
        for b in batches:
            x = _matrix(b.column(0))
            total += np.concatenate([[len(x), b.column(1).to_numpy(zero_copy_only=False).sum()], x.sum(axis=0), (x * x).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

    rows = labelled.select("stats", F.col("quality").cast("double"))
    got = _summed(rows, "x", moments)
    m = np.frombuffer(got) if got else np.zeros(2 * len(STATS) + 2)
    n = m[0]
    if n == 0:
        return KernelModel(np.zeros(len(STATS)), np.ones(len(STATS)))
    mean = m[2 : 2 + len(STATS)] / n
    sd = np.sqrt(np.maximum(m[2 + len(STATS) :] / n - mean**2, 0))
    model = KernelModel(mean, np.where(sd > 1e-9, sd, 1.0))

    def normal(batches):
        k = FEATURES + 1
        total = np.zeros(k * k + k)
        for b in batches:
            z, y = model.features(_matrix(b.column(0))), b.column(1).to_numpy(zero_copy_only=False)
            total += np.concatenate([(z.T @ z).ravel(), z.T @ y])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

    k = FEATURES + 1
    total = np.frombuffer(_summed(rows, "x", normal))
    penalty = np.eye(k) * RIDGE
    penalty[-1, -1] = 1e-9
    model.beta = np.linalg.solve(total[: k * k].reshape(k, k) + penalty, total[k * k :])

    def binned(batches):
        n_, s = np.zeros(BINS + 1), np.zeros(BINS + 1)
        for b in batches:
            at = np.rint((model.raw(_matrix(b.column(0))) + 0.5) * (BINS / 2)).astype(int)
            n_ += np.bincount(at, minlength=BINS + 1)
            s += np.bincount(at, b.column(1).to_numpy(zero_copy_only=False), BINS + 1)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([n_, s]).tobytes()], pa.binary())], names=["x"])

    total = np.frombuffer(_summed(rows, "x", binned)).reshape(2, -1)
    full = np.flatnonzero(total[0])
    model.at, model.value = isotonic(full * (2 / BINS) - 0.5, total[1][full], total[0][full])
    return model


def score_stats(stats: DataFrame, model: KernelModel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train_and_score(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[DataFrame, KernelModel]:
    """``doc_id, score, predicted`` for every row of docs, and the model.

    Learns from all labelled rows outside the held-out fifth. Texts are read once: statistics go to the
    shared folder. Null texts score as empty ones; null qualities are no labels; a document labelled
    twice counts twice; rows with equal or null doc_ids are scored each."""
    stats = scratch.write(with_stats(docs), "stats")
    rows = labels.where(F.col("quality").isNotNull() & ~held_out()).select("doc_id", "quality")
    model = fit(stats.join(rows, "doc_id").select("stats", "quality"))
    return score_stats(stats, model), model


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored, _ = train_and_score(spark, docs, labels, Scratch(spark, "quality"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns. The verdict is taken
    where the text is read, so texts are not shuffled."""
    _, model = train_and_score(spark, docs, labels, Scratch(spark, "quality"))

    return filter_texts(docs, lambda texts: model.score(text_stats([t or "" for t in texts])) >= THRESHOLD)

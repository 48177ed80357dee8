"""Toxicity by a character n-gram linear classifier on naive Bayes log-count ratios.

A text's features are the buckets of its distinct character n-grams (2 to 6 characters, lower-cased, white space as
one blank), each with the value of its log-count ratio between toxic and other training texts. Buckets whose ratio
is not clearly away from 0 are left out, and a ridge-penalised logistic regression weighs the rest. The fit sees a
bounded sample of labelled rows; scoring is one scan with two small tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrachron.llm.common import by_bytes, held_out, prepare

#: Bounds of the fit: toxic and other texts that are sampled.
TOXIC, OTHER = 2000, 4000
BITS, SHORTEST, LONGEST = 22, 2, 6
#: Bytes of text that are scored at a time; a byte takes some 150 while it is.
BATCH_BYTES = 1 << 18
LEAST_TEXTS, LEAST_Z, SMOOTH, PENALTY, THRESHOLD = 3, 3.5, 1.0, 0.1, 0.7
SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of every n-gram that lies within one text, and the text's number."""
    clean = [f" {' '.join(t.lower().split())} ".replace("\0", " ") for t in texts]
    points = np.frombuffer("\0".join(clean).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in clean])[: len(points)]
    inside = points != 0
    hashed, whole = points.copy(), inside
    for n in range(2, LONGEST + 1):
        if len(hashed) < 2:
            return
        hashed = hashed[:-1] * np.uint32(0x9E3779B1) + points[n - 1 :]
        whole = whole[:-1] & inside[n - 1 :]
        if n >= SHORTEST:
            mixed = (hashed ^ (hashed >> np.uint32(15)) ^ np.uint32(n)) * np.uint32(0x85EBCA6B)
            yield np.where(whole, mixed >> np.uint32(32 - BITS), np.uint32(1 << BITS)), owner[: len(hashed)]


@dataclass
class Model:
    kept: np.ndarray  #: the buckets that have a weight, sorted
    weights: np.ndarray
    intercept: float
    _columns: np.ndarray | None = None

    def __getstate__(self) -> tuple:
        return self.kept, self.weights, self.intercept

    def __setstate__(self, state: tuple) -> None:
        self.kept, self.weights, self.intercept = state
        self._columns = None

    @property
    def columns(self) -> np.ndarray:
        """Bucket to weight, -1 for those left out and for n-grams across texts (one more bucket)."""
        if self._columns is None:
            self._columns = np.full((1 << BITS) + 1, -1, np.int32)
            self._columns[self.kept] = np.arange(len(self.kept))
        return self._columns

    def present(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, weight) of each text's distinct kept buckets."""
        found = [np.zeros(0, np.int64)]
        for bucket, owner in buckets(texts):
            col = self.columns[bucket]
            at = np.flatnonzero(col >= 0)
            found.append(owner[at].astype(np.int64) << 32 | col[at])
        pairs = np.unique(np.concatenate(found))
        return pairs >> 32, pairs & 0xFFFFFFFF

    def scores(self, texts: list[str]) -> np.ndarray:
        rows, cols = self.present(texts)
        value = self.intercept + np.bincount(rows, self.weights[cols], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(value, -50, 50)))


def logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, size: int, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the logistic loss plus penalty / 2 * |w|^2 (L-BFGS with backtracking)."""

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = w[-1] + np.bincount(rows, values * w[cols], minlength=len(y))
        miss = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        grad = np.append(np.bincount(cols, values * miss[rows], minlength=size) + penalty * w[:-1], miss.sum())
        return float(np.logaddexp(0, z).sum() - y @ z + penalty / 2 * w[:-1] @ w[:-1]), grad

    w, past = np.zeros(size + 1), []
    now, grad = loss(w)
    for _ in range(200):
        q, alphas = grad.copy(), []
        for s, d, rho in reversed(past):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * d
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(grad).max())
        for (s, d, rho), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - rho * (d @ q))
        step = 1.0
        while True:
            after, slope = loss(w - step * q)
            if after <= now - 1e-4 * step * (grad @ q) or step < 1e-8:
                break
            step /= 2
        s, d = -step * q, slope - grad
        w, gain, now, grad = w + s, now - after, after, slope
        if s @ d > 1e-12:
            past = [*past[-9:], (s, d, 1 / (s @ d))]
        if gain < 1e-7 * max(1.0, now):
            break
    return w[:-1], float(w[-1])


def fit(texts: list[str], labels: list[int]) -> Model:
    """With one label only, or none, the score is the smoothed share of toxic texts."""
    y, step = np.array(labels, float), 64
    prior = (y.sum() + 0.5) / (len(y) + 1)
    empty = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not 0 < y.sum() < len(y):
        return empty
    counts = np.zeros((2, (1 << BITS) + 1))
    for i in range(0, len(texts), step):  # once for the counts, once more for the few buckets that are kept
        pairs = np.unique(np.concatenate([o.astype(np.int64) << 32 | b for b, o in buckets(texts[i : i + step])]))
        toxic = y[(pairs >> 32) + i] > 0
        for side in (0, 1):
            counts[side] += np.bincount(pairs[toxic == side] & 0xFFFFFFFF, minlength=counts.shape[1])
    q, p = counts[:, :-1]
    ratio = np.log((p + SMOOTH) / (y.sum() + 2 * SMOOTH)) - np.log((q + SMOOTH) / (len(y) - y.sum() + 2 * SMOOTH))
    kept = np.flatnonzero((p + q >= LEAST_TEXTS) & (np.abs(ratio) >= LEAST_Z * np.sqrt(1 / (p + SMOOTH) + 1 / (q + SMOOTH))))
    if not len(kept):
        return empty
    chosen = Model(kept, ratio[kept], 0.0)
    parts = [(rows + i, cols) for i in range(0, len(texts), step) for rows, cols in [chosen.present(texts[i : i + step])]]
    rows, cols = (np.concatenate(x) for x in zip(*parts, strict=True))
    w, b = logistic(rows, cols, ratio[kept][cols], y, len(kept), PENALTY)
    return Model(kept, w * ratio[kept], b)


def train(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 3, toxic: int = TOXIC, other: int = OTHER) -> Model:
    """Fit on the texts of at most ``toxic`` and ``other`` labelled ids, taken by hash among those that may be learned from.

    An id with several labels counts as toxic if one of them says so, and one with several texts is learned from by its
    smallest one, so that no more texts than ids reach the driver; null labels, ids and texts are not learned from.
    """
    prepare(df.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), modulus)).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    order = F.xxhash64(F.lit(6), "__id")
    chosen = [known.where(F.col("__label") == v).orderBy(order, "__id").limit(n) for v, n in ((1, toxic), (0, other))]
    texts = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).where(F.col("__text").isNotNull())
    rows = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "__id").groupBy("__id", "__label").agg(F.min("__text").alias("__text")).select("__text", "__label").toPandas()  # at most toxic + other rows
    rows = rows.groupby("__text", sort=True)["__label"].max().reset_index()
    return fit(rows["__text"].tolist(), rows["__label"].tolist())


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.7) of each row.

    A null text is scored as an empty one. Null and repeated ids give rows like others. Other columns are not read.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, BATCH_BYTES):
            values = model.scores([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64()), pa.array((values >= THRESHOLD).astype(np.int32))], schema=SCHEMA)

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), modulus).alias("held_out"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(df: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, whose text the model does not call toxic; null texts count as empty."""
    prepare(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, BATCH_BYTES):
            if batch.num_rows:
                yield batch.filter(pa.array(model.scores([t or "" for t in batch.column(at).to_pylist()]) < THRESHOLD))

    return df.mapInArrow(run, df.schema)

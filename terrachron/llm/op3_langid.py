"""Language identification by a blended-spectrum string kernel.

The kernel of two texts is the number of distinct character n-grams (n = 1, 2, 3, lower-cased, all characters) that
both hold, over the geometric mean of their own numbers. A bounded sample of labelled texts gives landmarks (Nystroem)
and one-versus-rest kernel ridge regressors. A text's kernel values against the landmarks are a product of its
presence row on the landmarks' n-grams with the landmarks' presence matrix, and its scores a product of these with the
regressors' weights; the two matrices are multiplied once, so a batch of texts is scored by one product. An n-gram is
one number without collisions: 21 bits a character. Scoring is one scan: nothing is shuffled, and what travels to the
tasks has the size of the landmarks' vocabulary.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrachron.llm.common import by_bytes, held_out, prepare

#: Bounds of the fit: sampled texts and landmarks over all languages, and languages (the most frequent ones).
SAMPLE, LANDMARKS, LANGUAGES = 1600, 256, 500
BATCH, PIECE, RIDGE, SHARPNESS = 256, 1 << 20, 1e-3, 5.0
#: Least score of a document that the pipeline's stage keeps.
LEAST_SCORE = 0.35
SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def grams(text: str) -> np.ndarray:
    """The sorted distinct n-grams (n = 1, 2, 3) of a lower-cased text, as numbers; long texts in pieces."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    found = []
    for i in range(0, len(points), PIECE):
        p = points[i : i + PIECE + 2].astype(np.int64) + 1  # from 1 on, so that n-grams of different lengths differ
        two = p[:-1] << 21 | p[1:]
        found.append(np.unique(np.concatenate([p, two, two[:-1] << 21 | p[2:]])))
    return found[0] if len(found) == 1 else np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))


@dataclass
class Spectrum:
    """The landmarks' n-grams, sorted."""

    known: np.ndarray

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row a text with 1 for each known n-gram it holds, and each text's number of n-grams, known or not."""
        out, sizes = np.zeros((len(texts), len(self.known)), np.float32), np.zeros(len(texts))
        for i, text in enumerate(texts):
            own = grams(text)
            sizes[i] = len(own)
            if len(own) and len(self.known):
                at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
                out[i, at[self.known[at] == own]] = 1
        return out, sizes

    def kernel(self, texts: list[str], matrix: np.ndarray) -> np.ndarray:
        """Presence rows, each over the root of its text's number of n-grams, times ``matrix``."""
        rows, sizes = self.presence(texts)
        return rows @ matrix / np.sqrt(np.maximum(sizes, 1))[:, None]


def spectrum(landmarks: list[str]) -> Spectrum:
    """The n-grams that occur in the landmarks."""
    return Spectrum(np.unique(np.concatenate([np.zeros(0, np.int64), *map(grams, landmarks)])))


@dataclass
class Model:
    languages: list[str]
    spectrum: Spectrum
    weights: np.ndarray  #: columns x languages, landmarks folded in
    intercept: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.spectrum.kernel(texts, self.weights) + self.intercept


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS) -> Model:
    """Kernel ridge regression of each language's indicator on the Nystroem features of at most SAMPLE-odd texts."""
    names = sorted(set(languages))
    by = {n: [t for t, x in zip(texts, languages, strict=True) if x == n] for n in names}
    each = max(2, landmarks // max(1, len(names)))
    marks = [t for n in names for t in by[n][:each]]
    s = spectrum(marks)
    L, sizes = s.presence(marks)
    L /= np.sqrt(np.maximum(sizes, 1)).astype(np.float32)[:, None]
    values, vectors = np.linalg.eigh((L @ L.T).astype(np.float64))
    good = values > 1e-6 * max(values.max(initial=0), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    K = np.concatenate([s.kernel(texts[i : i + BATCH], L.T) for i in range(0, len(texts), BATCH)]).astype(np.float64)
    features = K @ root
    mean = features.mean(axis=0)
    Y = np.array([[1.0 if x == n else -1.0 for n in names] for x in languages])
    share = np.array([1 / max(1, sum(y == n for y in languages)) for n in languages])  # each language weighs the same
    share = share[:, None] / share.mean()
    X = features - mean
    top = (share * Y).sum(axis=0) / share.sum()
    W = np.linalg.solve(X.T @ (share * X) + RIDGE * len(X) * np.eye(X.shape[1]), X.T @ (share * (Y - top)))
    return Model(names, s, (L.T.astype(np.float64) @ (root @ W)).astype(np.float32), (top - mean @ W).astype(np.float32))


def train(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 3, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model | None:
    """Fit on a sample, by hash of the text and in equal numbers of each language, of the rows that may be learned from.

    Languages are the ``languages`` most frequent ones. About 1.5 * ``sample`` texts (or 20 a language) reach the
    driver, repeated ones once, which keeps ``sample`` (8 a language). None if there is no such row.
    """
    spark = prepare(df.sparkSession)
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col), modulus)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not counts:
        return None
    each = max(8, min(400, sample // len(counts)))
    shares = spark.createDataFrame([(k, min(1.0, 1.5 * each / n + 8 / n)) for k, n in counts.items()], "lang string, share double")
    order = F.shiftrightunsigned(F.xxhash64(F.lit(3), "text"), 1) / F.lit(float(1 << 63))
    rows = known.withColumn("at", order).join(F.broadcast(shares), "lang").where(F.col("at") < F.col("share")).select("lang", "text", "at").distinct().toPandas()
    rows = rows.sort_values(["at", "text", "lang"]).groupby("lang", sort=True).head(each)
    return fit(rows["text"].tolist(), rows["lang"].tolist()) if len(rows) else None


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def label(texts: list[str], model: Model | None) -> tuple[list[str], list[float]]:
    """Language and score of each text, scored in batches."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    at = [j for j, t in enumerate(texts) if has_letter(t)] if model else []
    for i in range(0, len(at), BATCH):
        part = at[i : i + BATCH]
        value = SHARPNESS * model.scores([texts[j] for j in part]).astype(np.float64)
        odds = np.exp(value - value.max(axis=1, keepdims=True))
        for j, b, s in zip(part, odds.argmax(axis=1).tolist(), (odds.max(axis=1) / odds.sum(axis=1)).tolist(), strict=True):
            names[j], scores[j] = model.languages[b], s
    return names, scores


def identify(df: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row.

    ``und`` with score 0 if the text is null, empty or without a letter, or if nothing could be learned; otherwise a
    learned language, the first in alphabetical order among equals. score is a softmax of the regressors' values.
    Null and repeated ids give rows like others. Other columns of ``df`` are not read.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2 << 20):
            names, scores = label([t or "" for t in batch.column(2).to_pylist()], model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=SCHEMA)

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), modulus).alias("held_out"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(df: DataFrame, model: Model | None, *, text_col: str = "text", languages: Collection[str] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``df``, with all their columns, whose text is in one of ``languages`` (None: any that was learned) with a score of ``least`` or more.

    Null and empty texts and texts without a letter are in no language and go. Without a model no language is known,
    and nothing else goes. Repeated rows are judged alike; null ids and any other columns don't matter.
    """
    prepare(df.sparkSession)
    at = df.columns.index(text_col)
    wanted = None if languages is None else frozenset(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2 << 20):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            if model:
                keep = [n != "und" and (wanted is None or n in wanted) and s >= least for n, s in zip(*label(texts, model), strict=True)]
            else:
                keep = [has_letter(t) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def language_id(df: DataFrame, **names: str) -> DataFrame:
    """``identify`` with a model trained on ``df`` itself."""
    own = {k: v for k, v in names.items() if k in ("id_col", "text_col")}
    return identify(df, train(df, **names), **own)

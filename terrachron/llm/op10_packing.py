"""Packing token sequences by non-negative least squares on the length histogram.

1. One scan encodes each text once (distinct pre-tokens are encoded once a worker), cuts it into whole windows and a
   rest, and keeps a slim row for each piece; ids leave the task only as checksums.
2. The rests' lengths, rounded up to steps of ``STEP`` tokens, make a histogram of at most window / STEP bins, the
   only thing the driver sees. All combinations of at most three bins that fill the window are enumerated; Lawson and
   Hanson's active-set method solves for their repeat counts against the histogram; these are rounded down and what
   they leave is packed greedily, longest first, on counts.
3. Pieces are ranked within their bin (salted, so that a bin that holds a third of all pieces is spread) and the rank
   says which sequence and place a piece gets. Offsets are sums within a sequence, which holds few pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrachron.llm.common import by_bytes, prepare, stored
from terrachron.llm.pretokens import ids_of, word_level

STEP, MOST_KNOWN, SALT_ROWS = 8, 400_000, 20_000
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("bin", pa.int32())])


class Known(dict):
    """Pre-token, or special id, to its ids as little-endian 32-bit numbers; each is encoded when first met."""

    def __init__(self, path: str):
        self.path = path

    def __missing__(self, p: str | int) -> bytes:
        self[p] = ids = np.array([p] if isinstance(p, int) else ids_of(self.path, p), "<u4").tobytes()
        return ids


@lru_cache(maxsize=2)
def known_ids(path: str) -> Known:
    """A worker's pre-tokens; they outlive its tasks."""
    return Known(path)


def encode(text: str | None, known: Known, end_id: int) -> bytes:
    """The text's ids and the end id, four bytes each."""
    return b"".join(map(known.__getitem__, word_level(known.path, text or ""))) + end_id.to_bytes(4, "little")


def combinations(bins: int) -> np.ndarray:
    """Rows of three bins, 0 for none, largest first, that together fill ``bins`` bins' length."""
    out = [(bins, 0, 0)]
    for a in range(1, bins):
        for b in range(0, min(a, bins - a) + 1):
            c = bins - a - b
            if b >= c and (b or not c):
                out.append((a, b, c))
    return np.array(out)


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Lawson and Hanson's method for min |Ax - target|, x >= 0; column j of A counts the bins in columns[j].

    It ends when no column's gradient is positive, or after ``rounds`` exchanges with the feasible x it then has.
    """
    n, bins = len(columns), len(target) - 1
    x, passive, scale = np.zeros(n), [], max(1.0, float(np.abs(target).max()))
    dense = lambda j: np.bincount(columns[j], minlength=bins + 1) * (np.arange(bins + 1) > 0)
    A = np.zeros((bins + 1, 0))
    for _ in range(rounds or 6 * bins):
        rest = target - (A @ x[passive] if passive else 0)
        rest[0] = 0
        gradient = rest[columns].sum(axis=1)
        gradient[passive] = -np.inf
        j = int(gradient.argmax())
        if gradient[j] <= 1e-9 * scale:
            break
        passive.append(j)
        A = np.column_stack([A, dense(j)])
        while True:
            gram = A.T @ A + 1e-10 * np.eye(len(passive))
            z = np.linalg.solve(gram, A.T @ target)
            if (z > 1e-9).all():
                x[passive] = z
                break
            now = x[passive]
            low = z <= 1e-9
            step = min(1.0, float(np.min(now[low] / np.maximum(now[low] - z[low], 1e-300))))
            x[passive] = now + step * (z - now)
            keep = x[passive] > 1e-9
            if keep.all():
                keep[int(np.argmin(z))] = False
            x[[p for p, k in zip(passive, keep, strict=True) if not k]] = 0
            passive = [p for p, k in zip(passive, keep, strict=True) if k]
            A = A[:, keep]
            if not passive:
                break
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of bins and how often each is used; together they use up ``histogram`` (index 0 is unused)."""
    left, bins, out = histogram.astype(np.int64).copy(), len(histogram) - 1, []

    def use(pattern: tuple[int, ...], most: int) -> None:
        need = np.bincount(pattern, minlength=bins + 1)
        times = int(min([most, *(left[b] // need[b] for b in set(pattern))]))
        if times > 0:
            out.append((pattern, times))
            left[:] -= times * need

    use((bins,), int(left[bins]))
    columns = combinations(bins)
    x = nnls(columns, left.astype(float))
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 1:
            break
        use(tuple(int(b) for b in columns[j] if b), int(x[j]))
    while left.any():
        room, pattern, spare = bins, [], left.copy()
        while len(fit := np.flatnonzero(spare[1 : room + 1])):
            pattern.append(int(fit[-1]) + 1)
            spare[pattern[-1]] -= 1
            room -= pattern[-1]
        use(tuple(pattern), int(left.sum()))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]], bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of ranks in a bin, sorted: key (bin and first rank), first rank, first sequence, place in it."""
    rows, used, sequence = [], np.zeros(bins + 1, np.int64), 0
    for pattern, times in patterns:
        for slot, b in enumerate(pattern):
            rows.append((b, used[b], sequence, slot))
            used[b] += times
        sequence += times
    rows.sort()
    b, lo, seq, slot = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    return (b << 48) + lo, lo, seq, slot


def pieces(df: DataFrame, tokenizer_path: str, *, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, bin of each piece: whole windows, then the rest."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_ids(tokenizer_path)
        for batch in by_bytes(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text, known, end_id)
                for start in range(0, len(ids) // 4, window):
                    part = ids[4 * start : 4 * (start + window)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), len(ids) // 4, -(-len(part) // (4 * STEP))))
            if len(known) > MOST_KNOWN:
                known.clear()
            yield pa.RecordBatch.from_pydict(dict(zip(PIECES.names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in PIECES.names}, schema=PIECES)

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin int")


def pack(df: DataFrame, tokenizer_path: str, *, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row of ``df`` lies in exactly one piece and every sequence holds at most ``window`` ids. A null
    or empty text is the end id alone; a text longer than the window is cut at its multiples; null and repeated ids
    are packed like others; an empty table gives an empty one. Other columns of ``df`` are not read. ``window`` must
    be a multiple of 8, else it is a ValueError.
    """
    if window < STEP or window % STEP:
        raise ValueError(f"the window must be a multiple of {STEP}")
    spark = prepare(df.sparkSession)
    bins = window // STEP
    cut = stored(pieces(df, tokenizer_path, window=window, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    counts = {r["bin"]: r["n"] for r in cut.groupBy("bin").agg(F.count("*").alias("n")).collect()}  # at most window / STEP rows
    patterns = plan(np.array([counts.get(b, 0) for b in range(bins + 1)]))
    key, lo, first, slot = places(patterns, bins)
    salts = 64 + sum(counts.values()) // SALT_ROWS
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    sums = salted.groupBy("bin", "salt").agg(F.count("*").alias("n"))
    before = sums.select("bin", "salt", (F.sum("n").over(Window.partitionBy("bin").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = (
        salted.withColumn("own", F.row_number().over(Window.partitionBy("bin", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1)
        .join(before, ["bin", "salt"])
        .select(*PIECES.names, (F.col("before") + F.col("own")).alias("rank"))
    )
    out = PIECES.append(pa.field("rank", pa.int64())).append(pa.field("sequence_id", pa.int64())).append(pa.field("slot", pa.int64()))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, rank = batch.column(5).to_numpy().astype(np.int64), batch.column(6).to_numpy()
            at = np.searchsorted(key, (b << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first[at] + rank - lo[at]), pa.array(slot[at])], schema=out)

    placed = ranked.mapInArrow(assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin int, rank long, sequence_id long, slot long")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"))

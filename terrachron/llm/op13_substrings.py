"""Repeated passages by difference-cover anchors.

``COVER`` holds residues modulo ``PERIOD`` whose differences are all residues. So for any two places there is a shift of
less than ``PERIOD`` words after which both are at a residue of the cover. Two equal windows therefore share an anchor,
``anchor`` words at a cover position, at the same distance from their starts, if period and anchor fit in the window.

1. Hashes of the anchors are counted over all documents. Only anchors that two documents share, or one holds twice,
   can lie in a repeated window.
2. From each shared anchor the passage is extended: windows around it are candidates, and their whole words, hashed to
   128 bits, are compared. A window goes if an equal one starts earlier.
3. The words under such windows are removed.

Exact copies are told by two hashes of their text: the one with the smallest id stands for all. What a batch holds
several times is settled within it and stands once for the batch in the shuffle, so the hottest passage is a row a
batch. A document's anchors and windows come back to it in one join a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrachron.llm.common import by_bytes, drop_shuffles, drop_stored, prepare, release, stored, text_of

WINDOW = 20
#: A perfect difference set: each residue but 0 is a difference of two of these exactly once.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Rows that a task settles together, words whose hashes it keeps, bytes of text that it takes at a time.
HELD, WORDS, PIECE = 1_000_000, 300_000, 4 << 20
#: Stands for a null id: after all others.
LAST = (1 << 63) - 1


class Hashes(dict):
    """Two 64-bit hashes of each word met, by its number."""

    def __init__(self) -> None:
        super().__init__()
        self.digests = bytearray()

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_128_digest

        self.digests += xxh3_128_digest(word)
        self[word] = n = len(self)
        return n

    def of(self, documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first word's place of each document (and the end), and both hashes of all words."""
        if len(self) > WORDS:
            self.clear()
            self.digests = bytearray()
        first = np.concatenate([[0], np.cumsum([len(d) for d in documents])]).astype(np.int64)
        at = np.fromiter((n for d in documents for n in map(self.__getitem__, d)), np.int64, first[-1])
        both = np.frombuffer(bytes(self.digests), np.uint64).reshape(-1, 2)
        return first, both[at, 0], both[at, 1]


def run_hash(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The hash of ``size`` words from each place on, as signed numbers."""
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        out = (out ^ out >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + words[at + k]
    return (out ^ out >> np.uint64(32)).view(np.int64)


def anchors_of(first: np.ndarray, words: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place within it and hash of each anchor."""
    lengths = np.diff(first)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(first[-1]) - first[owner]
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    at = np.flatnonzero(cover[place % PERIOD] & (place + anchor <= lengths[owner]))
    return owner[at], place[at], run_hash(words, at, anchor)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in any of the spans from a start to before its end."""
    return np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n] > 0


def packed(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The values of each owner as bytes."""
    order = np.argsort(owner, kind="stable")
    one, start = np.unique(owner[order], return_index=True)
    return one, [x.tobytes() for x in np.split(values[order], start[1:])]


def unpacked(values: object, blobs: list[bytes] | None, kind: type) -> np.ndarray:
    return np.concatenate([np.asarray([] if values is None else values, kind), *(np.frombuffer(b, kind) for b in blobs or [])])


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """known (the id, or LAST), doc_id, a and b (two hashes of the text), text."""
    text = text_of(text_col)
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("known"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(13), text).alias("b"), text.alias("text"))


def shared_anchors(texts: DataFrame, window: int) -> DataFrame:
    """(a, hashes, blobs): of each different text, the hashes of its anchors that occur elsewhere too. (Should texts share their hash a, they get each other's anchors as well, which only makes more candidates.)"""
    anchor = window - PERIOD + 1
    schema = pa.schema([("hash", pa.int64()), ("a", pa.int64()), ("own", pa.binary())])

    def rows_of(keys: list[int], owner: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        """Hashes of one document of the batch, marks (a 0) of those of several places, and these for each document."""
        order = np.argsort(hashes, kind="stable")
        one, start, n = np.unique(hashes[order], return_index=True, return_counts=True)
        several = np.zeros(len(order), bool)
        several[order] = np.repeat(n > 1, n)
        once, marks = np.sort(order[start[n == 1]]), one[n > 1]  # in the documents' order, so that their names repeat and shrink in the shuffle
        mine, blobs = packed(owner[several], hashes[several])
        a = np.array(keys, np.int64)
        own = pa.array([None] * (len(once) + len(marks)) + blobs, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([hashes[once], marks, a[mine]])), pa.array(np.concatenate([a[owner[once]], np.zeros(len(marks), np.int64), a[mine]])), own], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, seen, owners, found, held = Hashes(), [], set(), [], [], 0
        for batch in by_bytes(batches, PIECE):
            some = []
            for a, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) not in seen:
                    seen.add((a, b))
                    keys.append(a)
                    some.append(text.encode().split())
            first, words, _ = known.of(some)
            owner, _, hashes = anchors_of(first, words, anchor)
            owners.append(owner + len(keys) - len(some))
            found.append(hashes)
            held += len(hashes)
            if held >= HELD:
                yield rows_of(keys, np.concatenate(owners), np.concatenate(found))
                keys, seen, owners, found, held = [], set(), [], [], 0
        if found:
            yield rows_of(keys, np.concatenate(owners), np.concatenate(found))
        release()

    rows = texts.select("a", "b", "text").mapInArrow(run, "hash long, a long, own binary")
    by = Window.partitionBy("hash")
    met = rows.withColumn("more", F.min("a").over(by) != F.max("a").over(by)).where("own IS NOT NULL OR more AND a <> 0")
    return met.groupBy("a").agg(F.collect_list(F.when(F.col("own").isNull(), F.col("hash"))).alias("hashes"), F.collect_list("own").alias("blobs"))


def later_windows(texts: DataFrame, window: int) -> DataFrame:
    """(known, a, starts, blobs): of each text (known, a, text, hashes, blobs), the starts of windows that also start earlier."""
    anchor = window - PERIOD + 1
    names = ["first", "second", "known", "a"]
    schema = pa.schema([*((n, pa.int64()) for n in names), ("start", pa.int32()), ("own", pa.binary())])

    def rows_of(keys: list[tuple[int, int]], owner: np.ndarray, start: np.ndarray, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
        """The earliest place in the batch of each window, and for each document those of its windows that come later."""
        known, a = np.array(keys, np.int64).reshape(-1, 2).T
        order = np.lexsort((start, known[owner], second, first))
        f, s, d, p = first[order], second[order], known[owner[order]], start[order]
        new = np.append(True, (f[1:] != f[:-1]) | (s[1:] != s[:-1]))[: len(f)]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        earliest = (d == d[head]) & (p == p[head])
        one, late = np.sort(order[earliest]), order[~earliest]
        mine, blobs = packed(owner[late], start[late].astype(np.int32))
        sides = [np.concatenate([x[one], y[mine]]) for x, y in ((first, a), (second, known))] + [np.concatenate([x[owner[one]], x[mine]]) for x in (known, a)]
        places = pa.array(np.concatenate([start[one], np.zeros(len(mine), np.int64)]).astype(np.int32))
        return pa.RecordBatch.from_arrays([*map(pa.array, sides), places, pa.array([None] * len(one) + blobs, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, parts, held = Hashes(), [], [], 0
        for batch in by_bytes(batches, PIECE):
            columns = batch.to_pydict()
            documents = [t.encode().split() for t in columns["text"]]
            first, one, two = known.of(documents)
            owner, place, hashes = anchors_of(first, one, anchor)
            cuts = np.searchsorted(owner, np.arange(len(documents) + 1))
            for k in range(len(documents)):
                n = first[k + 1] - first[k] - window + 1
                mine = slice(cuts[k], cuts[k + 1])
                met = place[mine][np.isin(hashes[mine], unpacked(columns["hashes"][k], columns["blobs"][k], np.int64))]
                if n < 1 or not len(met):
                    continue
                low, high = np.maximum(met - PERIOD + 1, 0), np.minimum(met, n - 1) + 1
                starts = np.flatnonzero(covered(low[low < high], high[low < high], n))
                at = first[k] + starts
                parts.append((np.full(len(starts), len(keys)), starts, run_hash(one, at, window), run_hash(two, at, window)))
                keys.append((columns["known"][k], columns["a"][k]))
                held += len(starts)
            if held >= HELD:
                yield rows_of(keys, *map(np.concatenate, zip(*parts, strict=True)))
                keys, parts, held = [], [], 0
        if parts:
            yield rows_of(keys, *map(np.concatenate, zip(*parts, strict=True)))
        release()

    rows = texts.select("known", "a", "text", "hashes", "blobs").mapInArrow(run, "first long, second long, known long, a long, start int, own binary")
    place = F.struct("known", "start")
    late = rows.withColumn("late", F.col("own").isNotNull() | (place > F.min(place).over(Window.partitionBy("first", "second")))).where("late")
    return late.groupBy("known", "a").agg(F.collect_list(F.when(F.col("own").isNull(), F.col("start"))).alias("starts"), F.collect_list("own").alias("blobs"))


def kept_words(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text) of each row (doc_id, text, copy, starts, blobs); copies of an earlier text lose all that a window covers."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, PIECE):
            columns = batch.to_pydict()
            ns, removed, kept = [], [], []
            for text, copy, starts, blobs in zip(columns["text"], columns["copy"], columns["starts"], columns["blobs"], strict=True):
                words = text.encode().split()
                n = len(words)
                if copy and n >= window:
                    left: list[bytes] = []
                else:
                    at = unpacked(starts, blobs, np.int32)
                    left = list(compress(words, (~covered(at, at + window, n)).tolist())) if len(at) else words
                ns.append(n)
                removed.append(n - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], schema=schema)

    return texts.select("doc_id", "text", "copy", "starts", "blobs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def both(a: str, b: str) -> Column:
    return (F.col(f"{a}.a") == F.col(f"{b}.a")) & (F.col(f"{a}.b") == F.col(f"{b}.b"))


def without_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text) of each row: its words but those under a window of words that also starts earlier.

    Earlier means a smaller id, or the same id and an earlier start. Null ids are one id after all others; rows that
    share an id share its places, and repeated rows are judged alike. Windows are judged on the input. Null texts have
    no words, and texts of fewer words than a window lose none. An empty table gives an empty one; other columns are
    not read. ``window`` must be at least ``PERIOD``.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    prepare(df.sparkSession)
    texts = keyed(df, id_col, text_col)
    firsts = texts.groupBy("a", "b").agg(F.min("known").alias("least"))
    shared = stored(shared_anchors(texts, window), "anchors")
    drop_shuffles(df.sparkSession)
    asked = firsts.alias("f").join(shared.alias("s"), "a").select("a", "f.b", "f.least", "s.hashes", "s.blobs")
    candidates = texts.alias("t").join(asked.alias("s"), both("t", "s") & (F.col("t.known") == F.col("s.least"))).select("t.known", "t.a", "t.text", "s.hashes", "s.blobs")
    later = stored(later_windows(candidates, window), "later")
    drop_stored(shared)
    drop_shuffles(df.sparkSession)
    judged = firsts.alias("f").join(later.alias("l"), (F.col("f.a") == F.col("l.a")) & (F.col("f.least") == F.col("l.known")), "left").select("f.a", "f.b", "f.least", "l.starts", "l.blobs")
    rows = texts.alias("t").join(judged.alias("j"), both("t", "j")).select("t.doc_id", "t.text", (F.col("t.known") > F.col("j.least")).alias("copy"), "j.starts", "j.blobs")
    return kept_words(rows, window)


def removals(df: DataFrame, **options: object) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row, as ``without_repeats``."""
    return without_repeats(df, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

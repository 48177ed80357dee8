"""Scoring texts with a bigram model kept in Elias-Fano tries.

P(w | h) = (c(h w) + m B(w)) / (c(h) + m), B(w) = (c(w) + 1/2) / Z, Z = N + (V + 1) / 2, m = STRENGTH Z / N: a bigram
model smoothed by the base distribution; it sums to one. A history's part of it, c(h w) / (c(h) + m), is what a trie
stores for each word below a history; the rest is m B(w) / (c(h) + m). Pairs are dealt to shards by the hash of their
history, and every shard works by itself:

1. Distinct words of chunks of documents, with counts, are summed by hash. That gives N, V and the few words that are
   so frequent that pairs after them are dealt by both hashes; only these words and sums reach the driver.
2. A chunk sends each shard its distinct pairs once, with their counts in training documents, however many documents
   have them, and passes on which pair each of its tokens is. A shard makes a trie of the training pairs (histories,
   the words after each, quantised smoothed probabilities), maps it into memory, looks up all pairs of each chunk,
   held-out ones as well, in the compressed levels, and returns histories' counts and pairs' probabilities.
3. A chunk turns these into sums over its documents' tokens.

Shards and chunks have bounded sizes, so their number grows with the corpus and nothing else does. Words are told
apart by 64-bit hashes, the words after a history by 40 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log10

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrachron.llm.common import by_bytes, held_out, prepare, text_of
from terrachron.llm.elias_fano import PREFIX_BITS, Trie, probability

STRENGTH = 500.0
#: Bounds: tokens and documents of a chunk, text bytes a shard should hold, least shards; a word is frequent at this part of a shard.
CHUNK_TOKENS, CHUNK_DOCS, SHARD_BYTES, LEAST_SHARDS, FREQUENT = 3_000_000, 60_000, 12 << 20, 16, 0.25
START, END = b" <s>", b" </s>"  # with a blank, no word is like them
MIX = np.uint64(0x9E3779B97F4A7C15)


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def squeeze(*columns: np.ndarray) -> bytes:
    import zstandard

    head = np.array([(len(c), c.dtype.itemsize) for c in columns], "<i4").tobytes()
    return head + zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns))


def spread(blob: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    heads, raw, at, out = np.frombuffer(blob[: 8 * n], "<i4").reshape(n, 2), zstandard.ZstdDecompressor().decompress(blob[8 * n :]), 0, []
    for size, wide in heads.tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * wide, at).reshape(wide, size).T).reshape(-1).view(f"<u{wide}"))
        at += size * wide
    return out


class Chunk:
    """Documents whose words are numbered together."""

    def __init__(self) -> None:
        self.ids, self.docs, self.tokens, self.parts = Ids({START: 0, END: 1}), [], 0, []

    def add(self, doc_id: int | None, out: bool, text: str | None) -> None:
        words = words_of(text)
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)))
        self.docs.append((doc_id, out, len(words) + 1))
        self.tokens += len(words) + 1

    def full(self) -> bool:
        return self.tokens >= CHUNK_TOKENS or len(self.docs) >= CHUNK_DOCS

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the chunk's words, and the rank of each number."""
        own = hashes_of(list(self.ids))
        order = np.argsort(own)
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own))
        return own[order], rank

    def unigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and counts of the training tokens' words."""
        own, rank = self.ranked()
        train = [p for p, d in zip(self.parts, self.docs, strict=True) if not d[1]]
        counts = np.bincount(np.concatenate([np.zeros(0, np.int64), *train]), minlength=len(own))
        counts[1] += len(train)
        by_rank = np.zeros(len(own), np.int64)
        by_rank[rank] = counts
        return own[by_rank > 0], by_rank[by_rank > 0]

    def pairs(self, shards: int, frequent: np.ndarray) -> tuple[dict[int, bytes], bytes]:
        """For each shard its histories' hashes and numbers of pairs, and each pair's word and training count; and what add_up needs.

        Pairs are sorted by shard, then history, then word; a run is a history's pairs in a shard.
        """
        own, rank = self.ranked()
        lengths = np.array([d[2] for d in self.docs])
        ends, end, start = np.cumsum(lengths), rank[1], rank[0]
        words = np.full(int(ends[-1]), end)
        words[np.delete(np.arange(len(words)), ends - 1)] = rank[np.concatenate([np.zeros(0, np.int64), *self.parts])]
        before = np.concatenate([[start], words[:-1]])
        before[(ends - lengths)] = start
        key, token = np.unique(before << 32 | words, return_inverse=True)
        learned = np.repeat(np.array([not d[1] for d in self.docs]), lengths)
        n = np.bincount(token[learned], minlength=len(key))
        history, word = key >> 32, key & 0xFFFFFFFF
        shard = shard_of(own, None, frequent, shards)[history]
        if len(frequent) and len(at := np.flatnonzero(np.isin(own, frequent)[history])):
            shard[at] = shard_of(own[history[at]], own[word[at]], frequent, shards)
        order = np.argsort(shard, kind="stable")
        shard, history, word, n = shard[order], history[order], word[order], n[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first = np.flatnonzero(np.append(True, (history[1:] != history[:-1]) | (shard[1:] != shard[:-1])))
        run = np.full(len(own), len(first))  # of a word as a history; the end is none
        run[history[first][::-1]] = np.arange(len(first))[::-1]
        child, sizes = own[word] >> np.uint64(64 - PREFIX_BITS), np.diff(np.append(first, len(key)))
        blobs, cuts = {}, np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
        for a, b in zip(cuts, cuts[1:], strict=False):
            r = slice(*np.searchsorted(first, [a, b]))
            blobs[int(shard[a])] = squeeze(own[history[first[r]]], sizes[r].astype("<u4"), child[a:b].astype("<u4"), (child[a:b] >> np.uint64(32)).astype("u1"), n[a:b].astype("<u4"))
        doc = np.repeat(np.arange(len(lengths)), lengths)
        sorted_ = np.sort(doc << 32 | place[token]) & 0xFFFFFFFF  # by document, then pair: their order does not matter
        steps = np.diff(np.append(0, sorted_))
        steps[ends - lengths] = sorted_[ends - lengths]
        return blobs, squeeze(steps.astype("<u4"), run[word].astype("<u4"), sizes.astype("<u4"))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    chunk = Chunk()
    for batch in by_bytes(batches, 4 << 20):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            chunk.add(*row)
            if chunk.full():
                yield chunk
                chunk = Chunk()
    if chunk.docs:
        yield chunk


def shard_of(words: np.ndarray, before: np.ndarray | None, frequent: np.ndarray, shards: int) -> np.ndarray:
    """By the word; for frequent words by the word before as well."""
    mixed = words.copy()
    if before is not None and len(frequent):
        at = np.isin(words, frequent)
        mixed[at] ^= before[at] * MIX
    return ((mixed * MIX) >> np.uint64(33)).astype(np.int64) % shards


def unigram_totals(slim: DataFrame, shards: int, size: int) -> tuple[int, int, int, dict[int, int]]:
    """Training tokens, distinct training tokens, training documents, and the frequent words' hashes with their counts.

    A shard sends the words that are frequent if tokens have 64 of the ``size`` bytes each, some dozens on average;
    which of them are is decided by the true number of tokens.
    """
    least = max(1.0, FREQUENT * size / 64 / shards)
    schema = pa.schema([("shard", pa.int32()), ("words", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            words, counts = chunk.unigrams()
            shard = shard_of(words, None, words, shards)
            order = np.argsort(shard, kind="stable")
            first = np.flatnonzero(np.append(True, shard[order][1:] != shard[order][:-1])) if len(order) else []
            found = [(int(shard[at[0]]), squeeze(words[at], counts[at].astype("<u4"))) for at in np.split(order, first[1:]) if len(at)]
            if found:
                s, blobs = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    end = int(hashes_of([END])[0])

    def total(group: pd.DataFrame) -> pd.DataFrame:
        parts = [spread(b, 2) for b in group["words"]]
        words, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([p[1] for p in parts])).astype(np.int64)
        top = np.flatnonzero(counts >= least)
        top = top[np.argsort(-counts[top], kind="stable")]
        ends = counts[words == end]
        return pd.DataFrame([{"tokens": int(counts.sum()), "words": len(words), "documents": int(ends.sum()), "top": words[top].astype(np.int64).tolist(), "top_counts": counts[top].tolist()}])

    rows = slim.mapInArrow(emit, "shard int, words binary").groupBy("shard").applyInPandas(total, "tokens long, words long, documents long, top array<long>, top_counts array<long>").collect()
    tokens = sum(r["tokens"] for r in rows)
    frequent = {w % (1 << 64): c for r in rows for w, c in zip(r["top"], r["top_counts"], strict=True) if c >= FREQUENT * tokens / shards}
    return tokens, sum(r["words"] for r in rows), sum(r["documents"] for r in rows), frequent


def score_shard(blobs: list[bytes], frequent: dict[int, int], prior: float) -> list[bytes]:
    """For each chunk's pairs: the histories' counts in training documents, and the places of the pairs' probabilities with their range."""
    parts = [spread(b, 5) for b in blobs]
    child = [high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64) for _, _, low, high, _ in parts]
    every = np.unique(np.concatenate([p[0] for p in parts]))
    key, n = [], []
    for (own, runs, _, _, times), c in zip(parts, child, strict=True):
        at = np.flatnonzero(times > 0)
        key.append(np.repeat(np.searchsorted(every, own), runs)[at].astype(np.uint64) << np.uint64(PREFIX_BITS) | c[at])
        n.append(times[at].astype(np.int64))
    keys, place = np.unique(np.concatenate(key), return_inverse=True)
    times = np.zeros(len(keys), np.int64)
    np.add.at(times, place, np.concatenate(n))
    of = (keys >> np.uint64(PREFIX_BITS)).astype(np.int64)
    counts = np.zeros(len(every), np.int64)
    np.add.at(counts, of, times)
    hot = np.array(sorted(frequent), np.uint64)
    totals = np.array([frequent[int(w)] for w in hot], np.int64)
    at = np.searchsorted(hot, every) if len(hot) else np.zeros(0, np.int64)
    if len(hot):
        at = np.minimum(at, len(hot) - 1)
        counts = np.where(hot[at] == every, totals[at], counts)
    known = np.flatnonzero(counts > 0)
    rank = np.cumsum(counts > 0) - 1
    dense = rank[of].astype(np.uint64) << np.uint64(PREFIX_BITS) | keys & np.uint64((1 << PREFIX_BITS) - 1)
    trie = Trie.mapped(Trie.build(every[known], counts[known], dense, np.log10(times / (counts[of] + prior))).dump())
    out = []
    for (own, runs, _, _, _), c in zip(parts, child, strict=True):
        r = trie.rank(own)
        found = np.where(r >= 0, trie.counts[np.maximum(r, 0)] if trie.histories.n else 0, 0)
        out.append(np.array([trie.low, trie.high], "<f8").tobytes() + squeeze(found.astype("<i8"), trie.find(np.repeat(r, runs), c).astype("<u2")))
    return out


def score(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; learned from rows not held out.

    Scores are log10 probabilities of whole texts with their end. A null text is empty: its one token is the end.
    Null and repeated ids give rows like others. Without any training row every base probability is 1. An empty table
    gives an empty one. Other columns of ``df`` are not read.
    """
    prepare(df.sparkSession)
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), modulus).alias("held_out"), F.col(text_col).alias("text"))
    size = df.agg(F.sum(F.octet_length(text_of(text_col))).alias("n")).first()["n"] or 0
    shards = max(LEAST_SHARDS, ceil(size / SHARD_BYTES))
    tokens, distinct, documents, frequent = unigram_totals(slim, shards, size)
    total = tokens + 0.5 * (distinct + 1)
    prior = STRENGTH * total / max(1, tokens)
    start, end = (int(h) for h in hashes_of([START, END]))
    frequent = {k: v for k, v in frequent.items() if k != end} | {start: documents}  # the end is no history
    hot = np.array(sorted(frequent), np.uint64)
    schema = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("pairs", pa.binary()), ("docs", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, chunk in enumerate(chunks(batches)):
            blobs, tokens_of = chunk.pairs(shards, hot)
            ids, outs, lengths = zip(*chunk.docs, strict=True)
            docs = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(outs), pa.array(lengths, pa.int64())], names=["doc_id", "held_out", "n_tokens"]).serialize().to_pybytes()
            rows = [(s, task + number, b, None) for s, b in blobs.items()] + [(-1 - task - number, task + number, tokens_of, docs)]  # a group of its own
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def score_group(group: pd.DataFrame) -> pd.DataFrame:
        if group["shard"].iloc[0] < 0:
            return group.rename(columns={"pairs": "found"})
        return pd.DataFrame({"shard": group["shard"], "chunk": group["chunk"], "found": score_shard(list(group["pairs"]), frequent, prior), "docs": None})

    begin_schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64())])

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        docs = pa.ipc.read_record_batch(pa.py_buffer(group["docs"].iloc[0]), begin_schema).to_pandas(types_mapper=pd.ArrowDtype)
        steps, word, sizes = spread(group["found"].iloc[0], 3)
        counts, seen = [], []
        for blob in group["found"].iloc[1:]:
            own, places = spread(blob[16:], 2)
            counts.append(own.astype(np.int64))
            seen.append(probability(places, *np.frombuffer(blob[:16], "<f8")))
        count = np.append(np.concatenate(counts), documents)
        history, own = np.repeat(count[:-1], sizes), count[word]
        base = np.log10((own + 0.5) / total)
        value = np.log10(np.concatenate(seen) + prior / (history + prior) * (own + 0.5) / total)
        n = docs["n_tokens"].to_numpy().astype(np.int64)
        ends, doc = np.cumsum(n), np.repeat(np.arange(len(n)), n)
        at = np.cumsum(steps.astype(np.int64))
        pair = at - np.repeat(np.append(0, at[ends[:-1] - 1]), n)
        sums = [np.bincount(doc, x[pair], minlength=len(n)) for x in (value, base, (own > 0).astype(float))]
        return pd.DataFrame({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": n, "n_known": sums[2].round().astype(np.int64), "train_tokens": tokens, "base_score": sums[1], "score": sums[0]})

    found = slim.mapInArrow(emit, "shard long, chunk long, pairs binary, docs binary").groupBy("shard").applyInPandas(score_group, "shard long, chunk long, found binary, docs binary")
    return found.groupBy("chunk").applyInPandas(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Elias-Fano sequences and a two-level n-gram trie made of them, searched in their compressed form.

All arrays lie flat in one buffer that can be mapped into memory; nothing is decoded but the numbers that are asked for.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np

PREFIX_BITS = 40  #: of the hash by which the words below a history are told apart
BLOCK = 8  #: 64-bit words for each entry of a directory
MISSING = 0xFFFF  #: the place of a pair that is not there
U = np.uint64
#: The place of the k-th one of each byte.
IN_BYTE = np.array([[next((b for b in range(8) if v >> b & 1 and bin(v & (1 << b) - 1).count("1") == k), 8) for k in range(8)] for v in range(256)], np.uint8)


def pack_bits(values: np.ndarray, wide: int) -> np.ndarray:
    """The low ``wide`` bits of each value, one after the other, as 64-bit words and a word of padding."""
    out = []
    for i in range(0, len(values), 1 << 16):
        bits = np.unpackbits(values[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :wide]
        out.append(np.packbits(bits, bitorder="little"))
    raw = np.concatenate([*out, np.zeros(0, np.uint8)])
    return np.concatenate([raw, np.zeros(-len(raw) % 8 + 8, np.uint8)]).view("<u8")


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers: low parts of ``wide`` bits, high parts in unary.

    A number's high part is the number of zeros before its one in ``high``; ``ones`` counts the ones before each block
    of ``high``, so that the k-th one or zero is found by a search of that directory and a look at one block.
    """

    def __init__(self, n: int, wide: int, most: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.wide, self.most, self.low, self.high, self.ones = n, wide, most, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray, universe_bits: int) -> EliasFano:
        values, n = values.astype(U), len(values)
        wide = max(0, min(63, universe_bits - max(1, n).bit_length() + 1))
        upper = values >> U(wide)
        most = int(upper[-1]) if n else 0
        size = -(-(n + most + 1) // (64 * BLOCK)) * 64 * BLOCK
        bits = np.zeros(size // 8, np.uint8)
        at = upper.astype(np.int64) + np.arange(n)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        high = bits.view("<u8")
        counts = np.bitwise_count(high).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        return cls(n, wide, most, pack_bits(values, wide), high, np.concatenate([[0], np.cumsum(counts)]).astype("<i8"))

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The places in ``high`` of the k-th ones, or zeros."""
        before = self.ones if one else np.arange(len(self.ones)) * (64 * BLOCK) - self.ones
        block = np.searchsorted(before, k, side="right") - 1
        left = k - before[block]
        words = self.high[block[:, None] * BLOCK + np.arange(BLOCK)]
        words = words if one else ~words
        counts = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        word = (counts <= left[:, None]).sum(axis=1)
        row = np.arange(len(k))
        left = left - np.where(word > 0, counts[row, word - 1], 0)
        octets = np.ascontiguousarray(words[row, word]).view(np.uint8).reshape(-1, 8)
        counts = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.int64)
        octet = (counts <= left[:, None]).sum(axis=1)
        left = left - np.where(octet > 0, counts[row, octet - 1], 0)
        return (block * BLOCK + word) * 64 + octet * 8 + IN_BYTE[octets[row, octet], left]

    def lower(self, i: np.ndarray) -> np.ndarray:
        """The low parts of numbers i."""
        if not self.wide:
            return np.zeros(len(i), U)
        at = i.astype(np.int64) * self.wide
        word, shift = at >> 6, (at & 63).astype(U)
        over = np.where(shift > 0, self.low[word + 1] << (U(64) - np.maximum(shift, U(1))), U(0))
        return (self.low[word] >> shift | over) & U((1 << self.wide) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Numbers i of the sequence."""
        i = np.asarray(i, np.int64)
        return (self.select(i, True) - i).astype(U) << U(self.wide) | self.lower(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first number that is x or more (n without one), and whether it is x."""
        x = np.asarray(x, U)
        upper, low = (x >> U(self.wide)), x & U((1 << self.wide) - 1)
        inside = upper <= U(self.most)
        u = np.where(inside, upper, U(0)).astype(np.int64)
        begin = np.where(u > 0, self.select(np.maximum(u - 1, 0), False) - (u - 1), 0)
        end = self.select(u, False) - u  # numbers with this high part lie between
        a, b = begin.copy(), end.copy()
        while (open_ := a < b).any():
            at = np.flatnonzero(open_)
            middle = (a[at] + b[at]) >> 1
            less = self.lower(middle) < low[at]
            a[at], b[at] = np.where(less, middle + 1, a[at]), np.where(less, b[at], middle)
        found = inside & (a < end)
        met = np.zeros(len(x), bool)
        at = np.flatnonzero(found)
        met[at] = self.lower(a[at]) == low[at]
        return np.where(inside, a, self.n), met

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.wide, self.most], "<u8"), self.low, self.high, self.ones]

    @classmethod
    def view(cls, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> EliasFano:
        n, wide, most = (int(v) for v in head)
        return cls(n, wide, most, low, high, ones.view("<i8"))


class Trie:
    """Histories, and below each one the words that follow it, with a quantised smoothed log10 probability for each.

    histories: hashes, monotone. counts: how often each occurs. pointers: where a history's words begin, monotone.
    words: the monotone sequence of (rank of the history) * 2 ** 40 + (40 bits of the word's hash), in which a word is
    found by a successor search between its history's pointers. places: 16-bit places of the probabilities between
    ``low`` and ``high``.
    """

    def __init__(self, histories: EliasFano, counts: np.ndarray, pointers: EliasFano, words: EliasFano, places: np.ndarray, low: float, high: float):
        self.histories, self.counts, self.pointers, self.words, self.places, self.low, self.high = histories, counts, pointers, words, places, low, high

    @classmethod
    def build(cls, histories: np.ndarray, counts: np.ndarray, keys: np.ndarray, logs: np.ndarray) -> Trie:
        """Sorted distinct hashes and their counts; sorted distinct keys (rank of history << 40 | word) and log10 probabilities."""
        if len(histories) >= 1 << (63 - PREFIX_BITS):
            raise ValueError(f"{len(histories)} histories are too many for one trie")
        low, high = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
        places = np.round((logs - low) / max(high - low, 1e-12) * (MISSING - 1)).astype("<u2")
        begins = np.searchsorted(keys, np.arange(len(histories) + 1, dtype=U) << U(PREFIX_BITS))
        rank_bits = PREFIX_BITS + max(1, int(len(histories)).bit_length())
        return cls(EliasFano.build(histories, 64), counts.astype("<i8"), EliasFano.build(begins, max(1, int(len(keys)).bit_length())), EliasFano.build(keys, rank_bits), places, low, high)

    def dump(self) -> bytes:
        """The trie as one flat run of 64-bit aligned arrays."""
        parts = [p.view(np.uint8) for p in (*self.histories.parts(), self.counts, *self.pointers.parts(), *self.words.parts(), self.places)]
        head = struct.pack("<dd", self.low, self.high) + np.array([len(p) for p in parts], "<i8").tobytes()
        return head + b"".join(p.tobytes() + b"\0" * (-len(p) % 8) for p in parts)

    @classmethod
    def load(cls, raw: mmap.mmap | bytes) -> Trie:
        """The trie of a mapped or given run of bytes; nothing is copied."""
        flat = np.frombuffer(raw, np.uint8)
        low, high = struct.unpack("<dd", flat[:16].tobytes())
        sizes, at, parts = flat[16 : 16 + 8 * 14].view("<i8"), 16 + 8 * 14, []
        for size in sizes.tolist():
            parts.append(flat[at : at + size])
            at += size + -size % 8
        wide = [p.view("<u8") for p in parts[:13]]
        return cls(EliasFano.view(*wide[:4]), wide[4].view("<i8"), EliasFano.view(*wide[5:9]), EliasFano.view(*wide[9:13]), parts[13].view("<u2"), low, high)

    @classmethod
    def mapped(cls, raw: bytes) -> Trie:
        """The trie of ``raw``, from a map of pages that belong to this process alone and go with the trie."""
        pages = mmap.mmap(-1, len(raw))
        pages.write(raw)
        return cls.load(pages)

    def rank(self, histories: np.ndarray) -> np.ndarray:
        """The rank of each history's hash, -1 where it is unknown."""
        if not self.histories.n:
            return np.full(len(histories), -1, np.int64)
        at, met = self.histories.successor(histories)
        return np.where(met, at, -1)

    def find(self, rank: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The place of each pair of a history's rank (-1: none) and a word's 40 bits, MISSING where it is unknown."""
        out = np.full(len(rank), MISSING, np.uint16)
        for i in range(0, len(rank), 1 << 16):
            at = i + np.flatnonzero(rank[i : i + (1 << 16)] >= 0)
            if len(at) and self.words.n:
                own = rank[at]
                place, met = self.words.successor(own.astype(U) << U(PREFIX_BITS) | words[at])
                inside = met & (place >= self.pointers.access(own).astype(np.int64)) & (place < self.pointers.access(own + 1).astype(np.int64))
                out[at[inside]] = self.places[place[inside]]
        return out

    def probability(self, places: np.ndarray) -> np.ndarray:
        """The stored probabilities of places, 0 for MISSING."""
        return probability(places, self.low, self.high)


def probability(places: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.where(places == MISSING, 0.0, 10.0 ** (low + places.astype(float) * max(high - low, 1e-12) / (MISSING - 1)))

"""SimHash near-duplicates through vantage-point trees.

Distinct fingerprints are the points. Vantage-point trees over a bounded sample split the space by Hamming distance
from vantage points; each leaf is a shard. Two points within 2 bits are equal in at least one third of the bits, so
there is a tree for each third, which splits by the distance in its third alone: points that are equal there are as far
from any vantage point, so they take the same way and meet in a leaf, and a point lies in one leaf of a tree. The
trees make three rows a point, however deep they are. Leaves that hold more than ``BLOCK`` points grow a tree of their
own, on a sample of their own points, round after round; only these are routed and counted again. Where no vantage point
parts a leaf's points by their third, as they are all equal there, the distance in all bits does: a point goes to the
inside of such a node if its distance d is at most the node's radius m, and to the outside if d > m - 2, since two points
within 2 bits differ by at most 2 in d (the triangle bound); there, points on the inner boundary are copied. A shard's
task goes on splitting in the same way and compares what is left, and it returns each point's smallest linked point
instead of all pairs. Only leaves that no
vantage point parts into fewer pairs are dealt out by pairs of blocks. Components of these
links are found by stars.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import repeat
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrachron.llm.common import by_bytes, drop_stored, free_name, prepare, stored, text_key
from terrachron.llm.components import components

SEED, SHINGLE, BITS = 42, 3, 2
#: All bits, and their thirds: points that differ in two bits are equal in one third.
WHOLE, THIRDS = np.uint64(2**64 - 1), (np.uint64(2**21 - 1), np.uint64(2**42 - 2**21), np.uint64(2**64 - 2**42))
#: Numbers of leaves that each tree has to itself, and points that are routed at a time.
LEAVES, ROUTED = 1 << 24, 1 << 16
#: Points that the tree is fitted on (and at most a quarter of all), points a shard should hold, and points of a block.
SAMPLE, SHARD, BLOCK, CANDIDATES = 16_384, 1_500, 40_000, 16
#: Points that all overfull leaves together are sampled with in a round.
AGAIN = 1 << 20
#: Ids (16 MB) that may be sent to every task.
BROADCAST_IDS = 1_000_000


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of a text's word shingles; 0 if it has no word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def majorities(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The signed fingerprints of runs of unsigned 64-bit hashes, which begin at ``starts`` and have one or more: a bit is 1 if set in over half of its run."""
    sizes = np.diff(np.append(starts, len(hashes)))
    out = np.zeros(len(starts), np.uint64)
    for bit in np.arange(64, dtype=np.uint64):
        out |= (2 * np.add.reduceat((hashes >> bit & np.uint64(1)).astype(np.int64), starts) > sizes).astype(np.uint64) << bit
    return out.view(np.int64)


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key and fp of each row."""
    prepare(df.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fingerprint(t) for t in batch.column(2).to_pylist()], pa.int64())], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, text_key long, fp long")


def distance(points: np.ndarray, one: np.int64, part: np.uint64 = WHOLE) -> np.ndarray:
    return np.bitwise_count((points ^ one).view(np.uint64) & part)


@dataclass
class Node:
    """A vantage point with its radius, the bits that its distances count and its halves; or a leaf of the tree of those bits."""

    point: np.int64 | None = None
    radius: int = 0
    inner: Node | None = None
    outer: Node | None = None
    leaf: int = -1
    part: np.uint64 = WHOLE


def overlap(part: np.uint64) -> int:
    """Points to be linked are equal in the third of their tree; in all bits they differ by up to ``BITS``."""
    return BITS if part == WHOLE else 0


def split(points: np.ndarray, *parts: np.uint64) -> tuple[np.int64, int, np.uint64] | None:
    """The candidate vantage point and radius that leave the fewest pairs on the two sides, copies included, by the first of ``parts`` that leaves fewer than there are; None if none does."""
    for part in parts:
        best, least, more = None, len(points) ** 2, overlap(part)
        for point in points[:: max(1, len(points) // CANDIDATES)][:CANDIDATES]:
            below = np.cumsum(np.bincount(distance(points, point, part), minlength=65))  # points at most so far away
            middle = int(np.searchsorted(below, len(points) / 2))
            for radius in range(max(0, middle - 2), min(63, middle + 2) + 1):
                inner, outer = int(below[radius]), len(points) - (int(below[radius - more]) if radius >= more else 0)
                if (cost := inner**2 + outer**2) < least:
                    best, least = (np.int64(point), radius, part), cost
        if best:
            return best
    return None


def sides(points: np.ndarray, at: np.ndarray, point: np.int64, radius: int, part: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Which of the indices ``at`` go to the inside and to the outside."""
    d = distance(points[at], point, part)
    return at[d <= radius], at[d > radius - overlap(part)]


def build(sample: np.ndarray, depth: int, part: np.uint64, first: int, *more: np.uint64) -> tuple[Node, int]:
    """A tree of ``part`` of at most ``depth`` levels over the sample, that splits by ``part`` or else ``more``, with leaves numbered from ``first`` on, and the number after them."""
    leaves = first

    def grow(points: np.ndarray, left: int) -> Node:
        nonlocal leaves
        found = split(points, part, *more) if left and len(points) >= 16 else None
        if not found:
            leaves += 1
            return Node(leaf=leaves - 1, part=part)
        d = distance(points, found[0], found[2])
        return Node(found[0], found[1], grow(points[d <= found[1]], left - 1), grow(points[d > found[1]], left - 1), part=found[2])

    return grow(sample, depth), leaves


def deepen(tree: Node, leaves: int, sizes: dict[int, int], samples: dict[int, np.ndarray]) -> tuple[Node, int]:
    """The tree whose overfull leaves have grown trees on their samples where these can be parted, with new leaves numbered from ``leaves`` on, and the number after them."""

    def copy(node: Node) -> Node:
        nonlocal leaves
        if node.point is not None:
            return replace(node, inner=copy(node.inner), outer=copy(node.outer))
        if node.leaf in samples:
            grown, after = build(samples[node.leaf], max(1, ceil(log2(sizes[node.leaf] / SHARD))), node.part, leaves, WHOLE)
            if grown.point is not None:
                leaves = after
                return grown
        return node

    return copy(tree), leaves


def leaves_of(tree: Node) -> list[int]:
    return [tree.leaf] if tree.point is None else leaves_of(tree.inner) + leaves_of(tree.outer)


def route(trees: list[Node], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, index of point) of every shard that a point visits."""
    leaves, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def down(node: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        if node.point is None:
            leaves.append(np.full(len(at), node.leaf))
            rows.append(at)
            return
        inner, outer = sides(points, at, node.point, node.radius, node.part)
        down(node.inner, inner)
        down(node.outer, outer)

    for tree in trees:
        down(tree, np.arange(len(points)))
    return np.concatenate(leaves), np.concatenate(rows)


def link(points: np.ndarray, small: int = 1024, part: np.uint64 = WHOLE) -> np.ndarray:
    """For sorted distinct points, the index of the smallest point that each is connected to within them, by links of points that are equal in ``part`` if that is a third; others may be left out."""
    parent = np.arange(len(points))

    def union(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal parent
        while True:
            x, y = parent[a], parent[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(up := parent[parent], parent):
                parent = up

    stack = [np.arange(len(points))]
    while stack:
        at = stack.pop()
        found = split(points[at], *dict.fromkeys((part, WHOLE))) if len(at) > small else None
        if found:
            stack += sides(points, at, *found)
            continue
        own = points[at]
        for i in range(0, len(at), 256):
            near = np.bitwise_count((own[i : i + 256, None] ^ own[None, i:]).view(np.uint64)) <= BITS
            x, y = np.nonzero(near)
            if len(x) > len(near):
                union(at[i + x], at[i + y])
    return parent


def near_links(points: DataFrame) -> DataFrame:
    """(u, v) links that connect whatever fp of ``points`` (distinct longs) lie within 2 bits of each other."""
    n, spark = points.count(), points.sparkSession
    sample = np.array(sorted(r["fp"] for r in points.orderBy(F.xxhash64("fp"), "fp").limit(min(SAMPLE, n // 4)).collect()), np.int64)
    sample, depth = np.random.default_rng(SEED).permutation(sample), max(0, ceil(log2(max(1, n / SHARD))))
    parts = THIRDS if depth else (WHOLE,)
    trees, ends = map(list, zip(*(build(sample, depth, part, i * LEAVES) for i, part in enumerate(parts)), strict=True))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """The points of many batches at a time: each walk through the trees has its cost."""
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            if sum(map(len, held)) >= ROUTED:
                yield np.concatenate(held)
                held = []
        if held:
            yield np.concatenate(held)

    def counted(trees: list[Node], known: set[int]) -> dict[int, int]:
        """Points of each leaf that is not ``known``; a task sums up what it has read."""
        schema = pa.schema([("leaf", pa.int64()), ("n", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: Counter[int] = Counter()
            for own in runs(batches):
                leaf, n = np.unique(route(trees, own)[0], return_counts=True)
                sums.update(dict(zip(leaf.tolist(), n.tolist(), strict=True)))
            some = [(k, v) for k, v in sums.items() if k not in known]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], pa.int64()) for i in (0, 1)], schema=schema)

        sums = points.select("fp").mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
        return {r["leaf"]: r["n"] for r in sums.collect()}  # a row a leaf

    def shards(trees: list[Node], blocks: dict[int, int], only: set[int] | None = None) -> DataFrame:
        """shard and fp of every point, or of those in the leaves ``only``."""
        schema = pa.schema([("shard", pa.int64()), ("fp", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own in runs(batches):
                leaf, row = route(trees, own)
                if only is not None:
                    there = np.isin(leaf, [*only])
                    leaf, row = leaf[there], row[there]
                shard, fp = leaf << 32, own[row]
                for one in [k for k, v in blocks.items() if v > 1]:  # each block meets each other and itself
                    at, rest, k = leaf == one, leaf != one, blocks[one]
                    mine = (fp[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % k
                    pairs = [(np.minimum(mine, j) << 16 | np.maximum(mine, j)) + (one << 32) for j in range(k)]
                    shard, fp, leaf = np.concatenate([shard[rest], *pairs]), np.concatenate([fp[rest], *[fp[at]] * k]), np.concatenate([leaf[rest], np.full(k * at.sum(), one)])
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp)], schema=schema)

        return points.select("fp").mapInArrow(run, "shard long, fp long")

    sizes, stuck = counted(trees, set()), set()
    while full := {k: v for k, v in sizes.items() if v > BLOCK and k not in stuck}:
        each = max(64, min(SAMPLE, AGAIN // len(full)))
        share = spark.createDataFrame([(k << 32, min(1.0, each / v)) for k, v in full.items()], "shard long, share double")
        at = F.shiftrightunsigned(F.xxhash64(F.lit(7), "fp"), 1) / F.lit(float(1 << 63))
        found = shards(trees, {}, {*full}).join(F.broadcast(share), "shard").where(at < F.col("share")).select("shard", "fp").orderBy("shard", F.xxhash64("fp"), "fp").toPandas()
        samples = {k >> 32: g["fp"].to_numpy(np.int64) for k, g in found.groupby("shard")}
        trees, ends = map(list, zip(*(deepen(tree, end, full, samples) for tree, end in zip(trees, ends, strict=True)), strict=True))
        new = counted(trees, {*sizes})
        left = {k for tree in trees for k in leaves_of(tree)}
        stuck |= full.keys() & left
        sizes = {k: v for k, v in (sizes | new).items() if k in left}
    blocks = {k: ceil(v / BLOCK) for k, v in sizes.items() if v > BLOCK}

    def connect(group: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(group["fp"].to_numpy())
        least = link(own, part=parts[(int(group["shard"].iloc[0]) >> 32) // LEAVES])
        at = np.flatnonzero(least != np.arange(len(own)))
        return pd.DataFrame({"u": own[at], "v": own[least[at]]})

    return shards(trees, blocks).groupBy("shard").applyInPandas(connect, "u long, v long")


def grouped(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, fp, root (the component's smallest fingerprint) and component_id of each row."""
    prepare(df.sparkSession)
    prints = stored(fingerprints(df, id_col=id_col, text_col=text_col), "prints")
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = components(near_links(points)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = points.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(ids, "root").select("fp", "root", "component_id"), "components")
    for done in (points, roots):
        drop_stored(done)
    return prints.join(named, "fp", "left").select("doc_id", "text_key", "fp", "root", "component_id")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row.

    Fingerprints of 2 or fewer differing bits are linked; component_id is the smallest id of any row that links reach.
    A null or wordless text has fingerprint zero and is linked like any other. Rows with a null id take part; they
    get their component's smallest id, or null where it has none. Repeated rows each give a row; an empty table gives
    an empty one. Other columns of ``df`` are not read.
    """
    return grouped(df, id_col=id_col, text_col=text_col).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", groups: Callable[..., DataFrame] = grouped) -> DataFrame:
    """``df`` without near-duplicates, all columns kept: of each component the row with its smallest id stays.

    ``groups`` gives the doc_id, text_key, root and component_id of each row: by fingerprints of whole texts, or
    ``near_copies`` by fingerprints of slices with an exact check of similarity. Rows are told apart by id and text, so unlinked texts that share an id all stay. Of linked rows that
    share the smallest id one stays, that of the smallest text_key. Rows without an id stay. Only the ids and keys that
    go meet the texts again; they are broadcast if they are counted at no more than ``BROADCAST_IDS``, else shuffled.
    """
    found = stored(groups(df, id_col=id_col, text_col=text_col).select("doc_id", "text_key", "root", "component_id"), "found")
    smallest = F.col("doc_id") == F.col("component_id")
    heads = found.where(smallest).groupBy("root", "doc_id").agg(F.sort_array(F.collect_set("text_key")).alias("keys"))
    id_name, key_name, twin = (free_name(df, n) for n in ("__id", "__key", "__twin"))
    named = lambda rows, key: rows.select(F.col("doc_id").alias(id_name), F.col(key).alias(key_name))
    others = heads.where(F.size("keys") > 1).select("doc_id", F.explode(F.slice("keys", F.lit(2), F.size("keys"))).alias("text_key"))
    go = named(found.where(~smallest), "text_key").unionByName(named(others, "text_key")).distinct()
    again = found.where(smallest).groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    same = (F.col(id_col).cast("long") == F.col(id_name)) & (text_key(F.col(text_col)) == F.col(key_name))
    go, again = (F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids for ids in (go, named(again, "text_key")))
    kept = df.join(go, same, "left_anti")
    twice = kept.join(again, same, "left_semi").withColumn(twin, text_key(F.col(text_col))).dropDuplicates([id_col, twin]).drop(twin)
    return kept.join(again, same, "left_anti").unionByName(twice)

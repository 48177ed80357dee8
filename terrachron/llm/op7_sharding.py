"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows fall into partitions by hash. How many rows of each partition go to each shard is drawn exactly (a multivariate
hypergeometric draw for each partition from what the shards still take), so all row and column sums hold. A
partition's rows are permuted locally and dealt by its row of the matrix; after the exchange the shard's rows are
permuted again. Only counts reach the driver: one a partition, of ``PARTITION_ROWS`` rows each. Both permutations
order by seeded hashes of the rows, so a lost task gives the same rows when it runs again, and the second is made of
independent hash ranges with summed offsets, so no task sorts a whole shard.
"""

from __future__ import annotations

from math import ceil, exp, lgamma, log2

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrachron.llm.common import prepare, stored, text_of

PARTITION_ROWS, LEAST_PARTITIONS = 200_000, 64
#: numpy draws exactly up to this many rows; beyond it ``search_draw`` does.
NUMPY_MOST = 900_000_000


def log_choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def search_draw(good: int, bad: int, drawn: int, u: float) -> int:
    """A hypergeometric value by inversion, searching outwards from the mode (some standard deviations' steps)."""
    low, high = max(0, drawn - bad), min(drawn, good)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    at_mode = exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn))
    left, p_left, right, p_right = mode, at_mode, mode, at_mode
    u -= at_mode
    while u > 0 and (left > low or right < high):
        if right < high:
            p_right *= (good - right) * (drawn - right) / ((right + 1) * (bad - drawn + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            p_left *= left * (bad - drawn + left) / ((good - left + 1) * (drawn - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
        if p_left < 1e-300 and p_right < 1e-300:
            break
    return mode


def matrix(rows: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of partition p that go to shard s; sums over s are ``rows``, sums over p are ``sizes``."""
    if sum(rows) != sum(sizes):
        raise ValueError("the shards' sizes must add up to the rows")
    rng, left, out = np.random.default_rng(seed), list(sizes), []
    for n in rows:
        rest, pool, own = n, sum(left), []
        for s, room in enumerate(left):
            pool -= room
            if rest == 0 or room == 0:
                got = 0
            elif s == len(left) - 1:
                got = rest
            elif room + pool <= NUMPY_MOST:
                got = int(rng.hypergeometric(room, pool, rest))
            else:
                got = search_draw(room, pool, rest, float(rng.random()))
            own.append(got)
            rest -= got
        left = [a - b for a, b in zip(left, own, strict=True)]
        out.append(own)
    return out


def shuffle_to_shards(df: DataFrame, keys: list[str], *, shards: int = 24, seed: int = 20267) -> DataFrame:
    """``df`` with shard (int, 0 to shards - 1) and slot (long, gapless from 0 in each shard).

    Shard sizes differ by one row at most and every assignment with these sizes is equally likely, as far as seeded
    hashes of ``keys`` are random. Nulls in keys hash like any value; rows that are equal in all keys take distinct
    slots by a hash of all columns, so that a task that is run again gives the same; an empty table gives an empty one. Columns of ``df`` named shard or slot are
    replaced; helper columns start with two underscores.
    """
    spark = prepare(df.sparkSession)
    df = df.drop("shard", "slot")
    total = df.count()
    parts = max(LEAST_PARTITIONS, ceil(total / PARTITION_ROWS))
    first, second = F.xxhash64(F.lit(seed), *keys), F.xxhash64(F.lit(seed + 1), *keys)
    dealt = df.withColumn("__part", F.pmod(first, F.lit(parts)).cast("int"))
    counts = {r["__part"]: r["n"] for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    drawn = matrix([counts.get(p, 0) for p in range(parts)], sizes, seed)
    ends = spark.createDataFrame([(p, np.cumsum(own).tolist()) for p, own in enumerate(drawn)], "__part int, __ends array<long>")
    maps = {f.name for f in df.schema.fields if "map<" in f.dataType.simpleString()}
    ties = [] if set(keys) >= set(df.columns) else [F.xxhash64(*(F.to_json(f"`{c}`") if c in maps else F.col(f"`{c}`") for c in df.columns))]
    local = Window.partitionBy("__part").orderBy(first, *keys, *ties)
    exchanged = (
        dealt.withColumn("__own", F.row_number().over(local) - 1)
        .join(ends, "__part")
        .withColumn("shard", F.size(F.filter("__ends", lambda e: e <= F.col("__own"))).cast("int"))
        .withColumn("__hash", second)
        .drop("__part", "__own", "__ends")
    )
    bits = max(3, ceil(log2(max(2, total / shards / PARTITION_ROWS))))
    ranged = exchanged.withColumn("__range", F.shiftrightunsigned("__hash", 64 - bits))
    sums = ranged.groupBy("shard", "__range").agg(F.count("*").alias("__n"))
    before = sums.select("shard", "__range", (F.sum("__n").over(Window.partitionBy("shard").orderBy("__range")) - F.col("__n")).alias("__before"))
    own = Window.partitionBy("shard", "__range").orderBy("__hash", *keys, *ties)
    slotted = ranged.withColumn("__own", F.row_number().over(own)).join(before, ["shard", "__range"])
    return slotted.withColumn("slot", (F.col("__before") + F.col("__own") - 1).cast("long")).select(*df.columns, "shard", "slot")


def shard_documents(df: DataFrame, *, shards: int = 24, seed: int = 20267, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null) of each row.

    size is the text's UTF-8 bytes plus 8 (null: 8); the checksum of a null text is that of an empty one.
    """
    prepare(df.sparkSession)
    text = text_of(text_col)
    slim = stored(df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32")), "shards")
    out = shuffle_to_shards(slim, ["doc_id", "text_crc32", "size"], shards=shards, seed=seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

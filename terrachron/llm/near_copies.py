"""Near copies by SimHash fingerprints of slices of their word shingles, checked exactly by Jaccard similarity.

A whole text's fingerprint can't tell a similarity of 0.8: there it differs by 10 of 64 bits on average, and by up to
19, and with such a radius a vantage-point tree prunes nothing. So texts are fingerprinted by slices, and the trees of
``op2_simhash`` link slices within 2 bits, as it does whole texts. No similar pair is lost, nor are all pairs compared.

Two sets of similarity s or more share at least s times the larger one's size, and the smaller has at least s times
the size of the larger. Three steps leave ever fewer sets, and none drops a set that has a similar one:

1. In any one order of all shingles, two similar sets share at least m of their first n - ceil(s n) + m, m a tenth of
   the smaller size. So a set of whose first shingles (by hash) fewer are in any other set's first ones has no near
   copy. What a batch of texts shares within itself is counted there, so no shingle meets in a task more than once a
   batch.
2. Of the sets that are left, those go of which less than s times all shingles are in another one.
3. The rest is cut into slices by the shingles' hashes, more slices than shingles in which two similar sets may differ
   (``sliced``), so that at least one slice of both is the same and has one fingerprint. Slices' fingerprints are the
   points of the vantage-point tree; sets of which it links slices are chained within classes of size and from class to
   class. A chain's sets meet in one task, which compares them exactly; those of a long chain meet by classes of size,
   each with the next, and by pairs of blocks.

Shingles that are not in another set cannot be common, so from step 2 on a set is its shared shingles and its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrachron.llm.common import by_bytes, drop_stored, prepare, stored, text_key
from terrachron.llm.components import components
from terrachron.llm.op2_simhash import majorities, near_links

SEED, SHINGLE, SIMILARITY = 42, 5, 0.8
#: Step 1: the part of the smaller set's size that the first shingles must share, and shingles of a batch.
MARGIN, BATCH_SHINGLES = 0.1, 400_000
#: Bytes of text that a task takes at a time.
PIECE = 2 << 20
#: Step 2: shingles that are put last, at most, and the texts that have one of them, at least; they never meet in a task.
FREQUENT, OFTEN = 200_000, 64
#: Names (16 MB) that may be sent to every task.
BROADCAST_SETS = 1_000_000
#: Sets of a chain that meet in one task.
TOGETHER, SALTS = 500, 16
MIX = np.int64(-0x61C8864680B583EB)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; one for all words if they are fewer; empty without a word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    each, size = np.fromiter(map(xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words)), min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ out >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
    return np.unique((out ^ out >> np.uint64(32)).view(np.int64))


def name_of(own: np.ndarray) -> int:
    """The signed 64-bit name of a set; 0 of the empty one."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(own.tobytes(), SEED)).view(np.int64)) if len(own) else 0


def least_shared(n: int, similarity: float) -> int:
    return int(np.ceil(similarity * n - 1e-9))


def least_column(n: Column, similarity: float) -> Column:
    return F.ceil(similarity * n - 1e-9)


def margin(n: int) -> int:
    return max(1, int(MARGIN * n))


def frequent(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that many texts have, and the place of each by its count."""
    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, PIECE):
            found = [shingles(t, size) for t in batch.column(0).to_pylist()]
            one, n = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(one[n > 1]), pa.array(n[n > 1].astype(np.int64))], schema=schema)

    counts = texts.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    rows = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()
    one = np.array([r["shingle"] for r in rows], np.int64)
    order = np.argsort(one)
    return one[order], (len(rows) - np.arange(len(rows)))[order]


def named(texts: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, name and n of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("name", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, PIECE):
            names, ns = [], []
            for text in batch.column(2).to_pylist():
                own = shingles(text, size)
                names.append(name_of(own))
                ns.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.int64()), pa.array(ns, pa.int64())], schema=schema)

    return texts.mapInArrow(run, "doc_id long, text_key long, name long, n long")


def may_have_copies(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Step 1: the names of sets that pass it.

    Rows are shingles with the set's name (0: several sets of one batch), and a row a set and batch, under a key of
    its own, with what is shared within the batch and the set's size. A set in several batches is counted in each.
    """
    schema = pa.schema([("shingle", pa.int64()), ("name", pa.int64()), ("known", pa.int32()), ("n", pa.int32())])

    def rows_of(sets: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        names = np.fromiter(sets, np.int64, len(sets))
        ns, firsts = zip(*sets.values(), strict=True)
        owner, each = np.repeat(np.arange(len(names)), [len(x) for x in firsts]), np.concatenate(firsts)
        one, place, n = np.unique(each, return_inverse=True, return_counts=True)
        within = n[place] > 1
        known = np.bincount(owner[within], minlength=len(names)).astype(np.int32)
        some, marks = ~within, one[n > 1]
        gap = np.zeros(int(some.sum()) + len(marks), bool)
        missing = np.concatenate([~gap, np.zeros(len(names), bool)])
        shingle = np.concatenate([each[some], marks, names * MIX])
        name = np.concatenate([names[owner[some]], np.zeros(len(marks), np.int64), names])
        filled = lambda x: pa.array(np.concatenate([np.zeros(len(gap), np.int32), np.asarray(x, np.int32)]), mask=missing)
        return pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(name), filled(known), filled(ns)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, tuple[int, np.ndarray]] = {}
        held = 0
        for batch in by_bytes(batches, PIECE):
            for text in batch.column(0).to_pylist():
                own = shingles(text, size)
                n, name = len(own), name_of(own)
                if n and name not in sets:
                    sets[name] = (n, own[: n - least_shared(n, similarity) + margin(n)].copy())
                    held += len(sets[name][1])
                if held >= BATCH_SHINGLES:
                    yield rows_of(sets)
                    sets, held = {}, 0
        if sets:
            yield rows_of(sets)

    own = Window.partitionBy("shingle")
    rows = texts.select("text").mapInArrow(run, "shingle long, name long, known int, n int").withColumn("more", F.min("name").over(own) != F.max("name").over(own))
    met = rows.where((F.col("name") != 0) & (F.col("n").isNotNull() | F.col("more")))
    sums = met.groupBy("name").agg(F.count("n").alias("times"), F.sum(F.coalesce(F.col("known"), F.lit(1))).alias("shared"), F.max("n").alias("n"))
    least = F.greatest(F.lit(1), F.floor(MARGIN * least_column(F.col("n"), similarity) - 1e-9))  # of the smallest set that may be similar
    return sums.where(F.col("shared") >= least * F.col("times")).select("name")


def shared_sets(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Step 2: name, n, own (shingles that another set has) and rare (the first of them in the order of rarity, for step 3) of sets that pass it."""
    often, place = frequent(texts, size)
    schema = pa.schema([("key", pa.int64()), ("name", pa.int64()), ("shingle", pa.int64()), ("place", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2 << 20):
            for name, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                own = shingles(text, size)
                if not len(own):
                    continue
                at = np.minimum(np.searchsorted(often, own), max(0, len(often) - 1))
                hot = often[at] == own if len(often) else np.zeros(len(own), bool)
                key = np.append(np.where(hot, (own ^ np.int64(name)) * MIX, own), np.array([name]) * MIX)
                ranks = np.append(place[at] + (1 << 40) if len(often) else np.zeros(len(own), np.int64), 0)
                plain = np.append(~hot, True)
                n = pa.array(np.append(np.zeros(len(own), np.int32), np.int32(len(own))), mask=np.append(np.ones(len(own), bool), False))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), name, np.int64)), pa.array(np.append(own, 0), mask=plain), pa.array(ranks, mask=plain), n], schema=schema)

    by_key = Window.partitionBy("key")
    rows = texts.select("text", "name").mapInArrow(run, "key long, name long, shingle long, place long, n int")
    rows = rows.select("*", F.count("*").over(by_key).alias("often"), (F.min("name").over(by_key) != F.max("name").over(by_key)).alias("more")).where("n IS NOT NULL OR place IS NOT NULL OR more")
    one = F.when(F.col("n").isNull(), F.struct(F.coalesce("place", "often").alias("often"), F.coalesce("shingle", "key").alias("shingle")))
    sets = rows.groupBy("name").agg(F.max("n").alias("n"), F.sort_array(F.collect_set(one)).alias("own"))
    sets = sets.where(F.size("own") >= least_column(F.col("n"), similarity))
    rare = F.slice("own", F.lit(1), (F.size("own") - least_column(F.col("n"), similarity) + 1).cast("int"))  # those that no other set has come first, and need no place
    return sets.select("name", "n", F.col("own.shingle").alias("own"), rare["shingle"].alias("rare"))


def class_width(similarity: float) -> float:
    """The logarithm of a class's largest size by its smallest; similar sets are of one class or of two next to each other."""
    return max(1e-9, -1.001 * float(np.log(similarity)))


def sliced(own: list[np.ndarray], rare: list[np.ndarray], sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of set, fingerprint) of the slices of each set of ``sizes`` whole shingles, of which ``own`` may be shared and ``rare`` are the rarest.

    A set is sliced for pairs whose smaller set is of its class of size, and of the class below. Two sets differ by at
    most d = (1 - s) / s times the smaller size, and each such shingle spoils one slice. So a set with more than d slices
    that are not empty meets all that are similar to it, less the shingles that no other set has. Where there are too
    few, in small sets mostly, the rarest shingles become slices of their own: two such sets share one of them.
    """
    lengths, width, apart = np.array([len(x) for x in own]), class_width(similarity), (1 - similarity) / similarity
    each, owner = np.concatenate(own).view(np.uint64), np.repeat(np.arange(len(own)), lengths)
    mixed = each * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    sets, prints = [], []
    for below in (0, 1):
        top = np.floor(np.exp((np.floor(np.log(sizes) / width) - below + 1) * width) + 1e-6)
        most = np.floor(apart * top + 1e-9).astype(np.int64)
        slices = np.where(most > 0, most + 2 + most // 10, 1)  # some stay empty
        at = (mixed * slices[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((at, owner))
        where, at = owner[order], at[order]
        starts = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (at[1:] != at[:-1])))
        sets.append(where[starts])
        prints.append(majorities(each[order], starts))
        spoiled = np.floor(apart * np.minimum(top, sizes) + 1e-9) - (sizes - lengths)
        few = np.flatnonzero(np.bincount(where[starts], minlength=len(own)) <= spoiled)
        sets.append(np.repeat(few, [len(rare[i]) for i in few]))
        prints.append(np.concatenate([*(rare[i] for i in few), np.zeros(0, np.int64)]))
    return np.concatenate(sets), np.concatenate(prints)


def slice_prints(sets: DataFrame, similarity: float) -> DataFrame:
    """name, n and fp of each slice of ``shared_sets``."""
    schema = pa.schema([("name", pa.int64()), ("n", pa.int32()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, PIECE):
            if batch.num_rows:
                name, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                lists = [[x.values.to_numpy() for x in batch.column(i)] for i in (2, 3)]
                at, fp = sliced(*lists, n.astype(np.int64), similarity)
                yield pa.RecordBatch.from_arrays([pa.array(name[at]), pa.array(n[at]), pa.array(fp)], schema=schema)

    return sets.select("name", "n", "own", "rare").mapInArrow(run, "name long, n int, fp long")


def similar_roots(sets: list[np.ndarray], sizes: np.ndarray, similarity: float) -> np.ndarray:
    """For each set, the first set that links of at least that similarity reach; ``sets``: what may be shared, ``sizes``: of the whole sets."""
    root = np.arange(len(sets))
    lengths = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    owner = np.repeat(root, lengths)
    order = np.lexsort((owner, ids))
    rows, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(ids))])
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    first = np.concatenate([[0], np.cumsum(lengths)])
    for i in range(1, len(sets)):
        mine = slice(first[i], first[i + 1])
        before = [rows[a:b] for a, b in zip(starts[ids[mine]].tolist(), place[mine].tolist(), strict=True) if a < b]
        if not before:
            continue
        shared = np.bincount(np.concatenate(before), minlength=i)
        near = np.flatnonzero(shared >= similarity * (sizes[:i] + sizes[i] - shared) - 1e-9)
        if len(near):
            met = np.unique(np.append(root[near], root[i]))
            root[: i + 1][np.isin(root[: i + 1], met)] = met[0]
    return root


def chains(slices: DataFrame) -> DataFrame:
    """(u, v) links that connect all names (name, step, slice) of a slice in classes of size (step) next to each other.

    A class is chained in ``SALTS`` parts, of which the first names are linked to each other and to the next class's,
    so that a slice that very many sets have meets in no task.
    """
    part = slices.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)))
    along = part.select("name", F.lag("name").over(Window.partitionBy("slice", "step", "salt").orderBy("name")).alias("last"))
    heads = part.groupBy("slice", "step", "salt").agg(F.min("name").alias("head"))
    across = heads.select("head", F.lag("head").over(Window.partitionBy("slice", "step").orderBy("salt")).alias("last"))
    tops = heads.groupBy("slice", "step").agg(F.min_by("head", "salt").alias("top"))
    by_step = Window.partitionBy("slice").orderBy("step")
    up = tops.select("top", F.when(F.lag("step").over(by_step) == F.col("step") - 1, F.lag("top").over(by_step)).alias("last"))
    links = along.unionByName(across.withColumnRenamed("head", "name")).unionByName(up.withColumnRenamed("top", "name"))
    return links.where("last IS NOT NULL").select(F.col("name").alias("u"), F.col("last").alias("v"))


def near_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key, root (the component's smallest set) and component_id of each row: the smallest id of any row that links of at least that similarity reach.

    Texts without a word are equal. Rows with a null id take part; they get their component's smallest id, or null
    where it has none. Repeated rows each give a row. An empty table gives an empty one. Other columns are not read.
    """
    prepare(df.sparkSession)
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    prints = stored(named(texts, shingle), "prints")
    passed = stored(may_have_copies(texts, shingle, similarity), "passed")
    known = F.coalesce("doc_id", F.lit(-(1 << 63)))
    few = lambda names: F.broadcast(names) if names.count() <= BROADCAST_SETS else names
    one = prints.join(few(passed), "name").groupBy("name").agg(F.min(F.struct(known.alias("id"), "text_key")).alias("row")).select("name", F.col("row.id").alias("__id"), F.col("row.text_key").alias("__key"))
    one = stored(one, "representatives")
    left = stored(texts.join(few(one), (known == F.col("__id")) & (F.col("text_key") == F.col("__key"))).select("text", "name"), "left")
    sets = stored(shared_sets(left, shingle, similarity), "sets")
    step = F.floor(F.log(F.col("n").cast("double")) / class_width(similarity))
    slices = stored(slice_prints(sets, similarity), "slices")
    points = stored(slices.select("fp").distinct(), "points")
    near = components(near_links(points)).select(F.col("u").alias("fp"), F.col("v").alias("near"))
    chained = components(chains(slices.join(few(near), "fp", "left").select("name", step.alias("step"), F.coalesce("near", "fp").alias("slice")).distinct()))
    members = chained.select(F.col("u").alias("name"), F.col("v").alias("chain")).unionByName(chained.select(F.col("v").alias("name"), F.col("v").alias("chain")).distinct())
    members = stored(members.join(sets.select("name", "n"), "name").select("name", "chain", step.alias("step")), "chained")
    classes = members.groupBy("chain", "step").agg(F.count("*").alias("m"))
    classes = classes.select("chain", "step", F.sum("m").over(Window.partitionBy("chain")).alias("together"), F.ceil(F.max("m").over(Window.partitionBy("chain")) / TOGETHER).cast("int").alias("blocks"))
    members = stored(members.join(classes, ["chain", "step"]), "chained")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("name").sort_values("name")
        names = group["name"].to_numpy()
        root = similar_roots([np.asarray(s, np.int64) for s in group["own"]], group["n"].to_numpy(np.int64), similarity)
        at = np.flatnonzero(root != np.arange(len(names)))
        return pd.DataFrame({"u": names[at], "v": names[root[at]]})

    mine, every = F.pmod(F.xxhash64("name"), F.col("blocks")), F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(every, lambda b: F.least(mine, b.cast("long")) * (1 << 31) + F.greatest(mine, b.cast("long")))
    long = F.col("together") > TOGETHER
    places = members.select("name", "chain", F.explode(F.when(long, F.array(F.col("step") - 1, F.col("step"))).otherwise(F.array(F.lit(-2).cast("long")))).alias("class"), F.when(long, pairs).otherwise(F.array(F.lit(0).cast("long"))).alias("pairs"))
    met = sets.select("name", "n", "own").join(few(places), "name").withColumn("pair", F.explode("pairs")).drop("pairs")
    roots = components(met.groupBy("chain", "class", "pair").applyInPandas(compare, "u long, v long")).select(F.col("u").alias("name"), F.col("v").alias("root"))
    leasts = prints.groupBy("name").agg(F.min("doc_id").alias("least"))
    rooted = stored(leasts.join(roots, "name", "left").select("name", "least", F.coalesce("root", "name").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    components_of = stored(rooted.join(ids, "root").select("name", "root", "component_id"), "components")
    for done in (passed, one, left, sets, slices, points, near, chained, members, roots, rooted):
        drop_stored(done)
    return prints.join(components_of, "name", "left").select("doc_id", "text_key", "root", "component_id")

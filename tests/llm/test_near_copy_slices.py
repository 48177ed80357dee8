"""The pipeline's near-duplicates stage: fingerprints of slices, linked by the vantage-point tree, then the exact check."""

import random

import numpy as np
import pytest

import corpus_pipeline
from terrachron.llm import near_copies, op2_simhash


def pair(rng, n, similarity=0.8):
    """Two sets of at least that similarity that differ as much as they may, the smaller of n shingles."""
    most = int((1 - similarity) / similarity * n + 1e-9)
    plain = lambda k: rng.integers(-(2**63), 2**63 - 1, k)
    base, more = plain(n), plain(most)
    if rng.integers(2):
        return base, np.append(base, more)  # the larger has all of the smaller
    cut = int(n * (1 - similarity) / (1 + similarity) + 1e-9)  # as many on either side
    return base, np.append(base[cut:], more[:cut])


@pytest.mark.parametrize("unshared", [False, True])
def test_similar_sets_share_the_print_of_a_slice(unshared):
    """Of every two similar sets of 1 to 400 shingles; with ``unshared``, what only one set has is not in ``own``, as after step 2."""
    rng = np.random.default_rng(6)
    for n in [*range(1, 60), *range(60, 400, 17)] * 8:
        two = pair(rng, n)
        whole = [set(x.tolist()) for x in two]
        both = whole[0] & whole[1]
        assert 5 * len(both) >= 4 * len(whole[0] | whole[1])
        own = [np.array(sorted(both if unshared else s), np.int64) for s in whole]
        rare = [o[: len(o) - near_copies.least_shared(len(s), 0.8) + 1] for o, s in zip(own, whole, strict=True)]
        at, prints = near_copies.sliced(own, rare, np.array([len(s) for s in whole]), 0.8)
        assert set(prints[at == 0].tolist()) & set(prints[at == 1].tolist())


def test_prints_of_runs_are_those_of_texts():
    import xxhash

    rng = random.Random(2)
    for n in (1, 2, 3, 40):
        words = [f"w{rng.randint(0, 99)}" for _ in range(n)]
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, n - 2))]
        runs = np.array([7, *hashes, *hashes[:1]], np.uint64)
        assert op2_simhash.majorities(runs, np.array([0, 1, 1 + len(hashes)])).tolist() == [7, op2_simhash.fingerprint(" ".join(words)), int(np.uint64(hashes[0]).view(np.int64))]


def test_stage_finds_its_pairs_by_fingerprints_and_tree(spark, monkeypatch):
    """Links come from the tree alone: nothing is found without it; prints a bit apart are still linked; more links add nothing."""
    rng = random.Random(5)
    rows = []
    for i in range(20):
        own = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
        for j in range(3):
            copy = list(own)
            copy[10 + 30 * j] = f"x{i}-{j}"
            rows.append((3 * i + j, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = lambda: sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    whole, seen = near_copies.slice_prints, []

    def tree(points):
        seen.append(points.count())
        return op2_simhash.near_links(points)

    monkeypatch.setattr(near_copies, "near_links", tree)
    assert kept() == list(range(0, 60, 3)) and seen and seen[0] > 60

    bit = lambda by: lambda sets, similarity: whole(sets, similarity).selectExpr("name", "n", f"fp ^ {by} AS fp")
    monkeypatch.setattr(near_copies, "slice_prints", bit("shiftleft(1L, cast(pmod(name, 2) as int))"))  # two bits apart
    assert kept() == list(range(0, 60, 3))
    monkeypatch.setattr(near_copies, "slice_prints", bit("xxhash64(name)"))
    assert kept() == list(range(60))
    monkeypatch.setattr(near_copies, "slice_prints", whole)
    monkeypatch.setattr(near_copies, "near_links", lambda points: points.crossJoin(points.selectExpr("min(fp) AS v")).selectExpr("fp AS u", "v"))
    assert kept() == list(range(0, 60, 3))


def test_trees_deal_points_out_in_proportion(spark, monkeypatch):
    """Three rows a point go to shards, however many points and levels; leaves that grow trees later are counted in."""
    rng, seen = np.random.default_rng(9), []
    plain = type(spark.range(1)).groupBy

    def grouping(self, *cols):
        if self.columns == ["shard", "fp"]:
            seen.append(self.count())
        return plain(self, *cols)

    monkeypatch.setattr(type(spark.range(1)), "groupBy", grouping)
    monkeypatch.setattr(op2_simhash, "SHARD", 8)
    for n, block in ((1000, 40_000), (5000, 40_000), (5000, 300)):
        monkeypatch.setattr(op2_simhash, "BLOCK", block)
        monkeypatch.setattr(op2_simhash, "SAMPLE", 16_384 if block > 300 else 128)
        own = rng.integers(-(2**63), 2**63 - 1, n)
        own[n // 2 :] = own[: n // 2] ^ (np.int64(1) << rng.integers(0, 63, n // 2)) ^ (np.int64(1) << rng.integers(0, 63, n // 2))
        own, seen[:] = np.unique(own), []
        links = op2_simhash.near_links(spark.createDataFrame([(p,) for p in own.tolist()], "fp long"))
        assert sum(seen) == 3 * len(own)
        assert len({(r["u"], r["v"]) for r in links.collect()}) >= n // 2 - (n - len(own))

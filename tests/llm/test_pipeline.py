"""The pipeline's stages against what each rejects, one by one."""

import random

import corpus_pipeline
from terrachron.llm import near_copies, op2_simhash
from tests.llm.test_operators import brute_contamination


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    syllables = "ka lo mi ren tus vor pel din sha gro bek wim".split()
    word = lambda: "".join(rng.choices(syllables, k=2))
    texts = [" ".join(word() for _ in range(rng.randint(30, 90))) for _ in range(240)]
    labels = []
    for i in range(0, 240, 4):
        texts[i] += " vexnot gorblat" * 3
    labels = [(i, 0, int(i % 4 == 0)) for i in range(240)]
    item = " ".join(word() for _ in range(15))
    texts[1], texts[2], texts[3] = "1234 5678", texts[1] + " " + item, texts[5]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(400, "", "en", "s", 0), (401, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sets = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sets.append({r["doc_id"] for r in docs.collect()})
    assert sets[0] == {i for i in range(240) if i % 4} | {400, 401}
    assert sets[1] == sets[0] - {1, 400, 401}
    prints = {i: op2_simhash.fingerprint(texts[i]) for i in sets[1]}
    assert 5 in sets[1] and sets[2] == {i for i in sets[1] if not any(j < i and (prints[i] ^ prints[j]).bit_count() <= 2 for j in sets[1])}
    assert 5 not in sets[2]
    dirty = {i for i, _, _, _, _, bad in brute_contamination([(i, texts[i]) for i in sets[2]], [(0, item)]) if bad}
    assert dirty == {2} and sets[3] == sets[2] - dirty
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == sets[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_empty_tables_null_ids_and_no_labels(spark, tmp_path):
    """No rows, no labels and no items; and a few rows without an id or text, with columns of other names."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "some words of a text", "en", None, 1, 2, 3), (1, None, None, "s", 1, 2, 3), (2, "", "en", "s", None, 2, 3), (3, "other words of a text", "en", "s", 4, 2, 3), (3, "other words of a text", "en", "s", 4, 2, 3), (None, "4711", None, None, None, 2, 3)]
    some = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __id long, score long")
    for docs, want in ((some.limit(0), [0, 0, 0, 0]), (some, [6, 3, 2, 2])):
        for (_, stage), n in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == some.columns
            docs = spark.createDataFrame(out.collect(), some.schema)
            assert docs.count() == n
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == want[-1]


def test_near_duplicates_takes_five_words_and_four_fifths(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.choice([4, 5, 60, 150]))) for _ in range(60)]
    common = " ".join(rng.choices(words, k=30))
    for i in range(60):
        own = texts[i].split()
        for changed in (1, 2, 3, 5):
            copy = list(own)
            for at in rng.sample(range(len(own)), min(changed, len(own))):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
        texts.append(texts[i].upper() if i % 2 else common + " " + texts[i])
    rng.shuffle(texts)
    rows = list(enumerate(texts))

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    near = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                near += a != sets[j]
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert near > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_rows_that_share_an_id_are_told_apart_by_text(spark):
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"w{rng.randint(0, 999)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, a), (2, c), (3, d), (3, d.upper()), (None, a), (7, None), (7, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for kept in (op2_simhash.keep_one(docs), corpus_pipeline.near_duplicates(spark, docs, "")):
        got = [tuple(r) for r in kept.collect()]
        assert sorted((i or 0, (t or "").lower()) for i, t in got) == sorted([(1, a), (1, b), (2, c), (3, d), (0, a), (7, "")])


def test_large_chains_lose_no_pair(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(n, " ".join(words[: n + 4])) for n in range(4, 200)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(near_copies, "TOGETHER", 1)
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert found == {n: 4 for n in range(4, 200)}

"""Each operator against brute force on small inputs with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrachron.llm import op1_tokens, op2_simhash, op3_langid, op4_lm, op5_html, op6_toxicity, op7_sharding, op8_gif, op9_decontamination, op10_packing
from terrachron.llm.elias_fano import EliasFano, Trie
from terrachron.llm.pretokens import load
from terrachron.llm.queries import tokenizer

WORDS = "the and of to stone river Mountain GREEN über naïve 数据 a1 b2, c; don't x² -- \t\n".split(" ")
TEXTS = [None, "", "   ", "a", "The The the", "<|endoftext|> in text <|startoftext|>", "日本語 テキスト ａｂｃ", "Kelvin İ ß É é", "x" * 5000, "same text here now", "same text here now"]


def documents(spark, n=60, seed=1):
    rng = random.Random(seed)
    texts = TEXTS + [" ".join(rng.choices(WORDS, k=rng.choice([1, 3, 8, 40, 300]))) for _ in range(n)] + [" ".join(rng.choices(WORDS, k=6000))]
    rows = [(i if i != 20 else None, t, "en", f"s{i % 3}", 1, 7) for i, t in enumerate(texts)] + [(5, TEXTS[5], "en", "s", 1, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, shard int").repartition(3)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ascii_words(text):
    return re.findall("[^\x20\x09-\x0d]+", low(text))


def out(text, modulus):
    return zlib.crc32(str("" if text is None else text).encode()) % modulus == 1


def same(rows, wanted):
    assert Counter(rows) == Counter(wanted)


def test_token_counts(spark):
    df = documents(spark)
    lib = load(tokenizer("byte_bpe_50k.json"))
    got = [tuple(r) for r in op1_tokens.token_counts(df, tokenizer("byte_bpe_50k.json"), limit=20).collect()]
    same(got, [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False)), n > 20) for i, t in pairs(df)])
    assert op1_tokens.token_counts(df.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0


def test_overfull_leaves_grow_trees(spark, monkeypatch):
    """Links stay the same when every leaf is overfull, whether its points can be parted or not."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(1, 4), replace=False)) for b in base for _ in range(3)]
    ball = [1 << i | 1 << j for i in range(24) for j in range(i)]  # all within 4 bits of each other, near zero
    own = sorted({*map(int, base), *near, *ball, 0})
    points = spark.createDataFrame([(p,) for p in own], "fp long").repartition(4)
    want = {tuple(sorted(c)) for c in brute_groups(own)}
    for block, shard in ((40_000, 1_500), (60, 20), (5, 4)):
        monkeypatch.setattr(op2_simhash, "BLOCK", block)
        monkeypatch.setattr(op2_simhash, "SHARD", shard)
        parent = {p: p for p in own}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in op2_simhash.near_links(points).collect():
            a, b = sorted((find(r["u"]), find(r["v"])))
            parent[b] = a
        groups = defaultdict(list)
        for p in own:
            groups[find(p)].append(p)
        assert {tuple(sorted(g)) for g in groups.values()} == want


def brute_groups(points):
    a = np.array(points, np.int64)
    root = np.arange(len(a))
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count((a ^ a[i]).view(np.uint64)) <= 2):
            low, high = sorted((root[i], root[j]))
            root[root == high] = low
    groups = defaultdict(list)
    for p, r in zip(points, root, strict=True):
        groups[r].append(p)
    return groups.values()


def test_helper_columns_may_clash(spark):
    """Columns of the input named like helpers do no harm."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, 1, 1, 1, "a"), (2, text, 2, 2, 2, "b"), (3, "other words here", 3, 3, 3, "c"), (None, None, 4, 4, 4, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id long, __KEY long, __n long, __part string")
    kept = op2_simhash.keep_one(df)
    assert kept.columns == df.columns
    same([r["doc_id"] for r in kept.collect()], [1, 3, None])
    items = spark.createDataFrame([(1, " ".join(text.split()[3:13]))], "item_id long, text string")
    clean = op9_decontamination.keep_clean(df, items)
    assert clean.columns == df.columns
    same([r["doc_id"] for r in clean.collect()], [3, None])
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    assert op6_toxicity.keep_clean(df, op6_toxicity.train(df, labels)).columns == df.columns


def test_equal_keys_take_slots_by_all_columns(spark):
    rows = [(1, f"v{i}", {"k": i}) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, v string, m map<string,int>")
    got = [{(r["v"], r["shard"], r["slot"]) for r in op7_sharding.shuffle_to_shards(df.repartition(n), ["k"], shards=4).collect()} for n in (1, 7)]
    assert got[0] == got[1] and len({v for v, _, _ in got[0]}) == 50


def test_window_of_packing_is_checked(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for window in (0, 4, 2047):
        with pytest.raises(ValueError):
            op10_packing.pack(df, tokenizer("word_bpe_49k.json"), window=window)


def test_fingerprints_and_components(spark):
    import xxhash

    def fingerprint(text):
        w = ascii_words(text)
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    df = documents(spark)
    rows = [(i, fingerprint(t)) for i, t in pairs(df)]
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for i, f in rows:
        if i is not None:
            least[find(f)].append(i)
    want = [(i, f"{f:016x}", min(least[find(f)], default=None)) for i, f in rows]
    same([tuple(r) for r in op2_simhash.near_duplicates(df).collect()], want)
    kept = op2_simhash.keep_one(df)
    assert kept.columns == df.columns
    same([r["doc_id"] for r in kept.collect()], [*{c for _, _, c in want if c is not None}, *[i for i, _, _ in want if i is None]])
    assert op2_simhash.near_duplicates(df.limit(0)).count() == 0 and op2_simhash.keep_one(df.limit(0)).count() == 0


def test_vantage_point_trees_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63 - 1, 300)
    near = np.concatenate([base, *(base[rng.integers(0, 300, 200)] ^ (np.int64(1) << rng.integers(0, 63, 200)) for _ in range(3))])
    hub = base[0] ^ (np.int64(1) << np.arange(60))
    points = np.unique(np.concatenate([near, hub, hub[:, None] ^ (np.int64(1) << np.arange(0, 60, 7))[None]], axis=None))
    whole = op2_simhash.link(points, small=10**9)
    assert np.array_equal(op2_simhash.link(points, small=8), whole)
    monkeypatch.setattr(op2_simhash, "SHARD", 50)
    monkeypatch.setattr(op2_simhash, "BLOCK", 40)
    links = op2_simhash.components(op2_simhash.near_links(spark.createDataFrame([(int(p),) for p in points], "fp long")))
    root = {r["u"]: r["v"] for r in links.collect()}
    groups = defaultdict(set)
    for p in points.tolist():
        groups[root.get(p, p)].add(p)
    want = defaultdict(set)
    for p, w in zip(points.tolist(), whole.tolist(), strict=True):
        want[w].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


LANGUAGES = {"en": "the and of with this that were from", "de": "und der die nicht für über schön ganz", "fr": "les des être où été dans très français"}


def language_rows(spark, n=150):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(LANGUAGES[k].split(), k=rng.randint(4, 60))), k) for i in range(n) for k in [rng.choice(list(LANGUAGES))]]
    rows += [(900, None, "en"), (901, "", None), (902, "123 !?", "de"), (903, "the and of", None), (None, "und der die", "de"), (3, rows[3][1], rows[3][2])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_id(spark):
    df = language_rows(spark)
    rows = op3_langid.language_id(df).collect()
    truth = defaultdict(set)
    for r in df.collect():
        truth[r["doc_id"]].add(r["lang"])
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == out(r["doc_id"], 3) for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (900, 901, 902)} == {"und"}
    assert all(r["lang_pred"] in truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900)
    kept = op3_langid.keep_identified(df, op3_langid.train(df))
    assert kept.columns == df.columns and kept.count() == df.count() - 3
    empty = df.limit(0)
    assert op3_langid.train(empty) is None and op3_langid.language_id(empty).count() == 0


def test_kernel_is_the_number_of_shared_grams():
    marks = ["abcab", "xyz ab", "日本\0語 ab"]
    s = op3_langid.spectrum(marks)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    texts = ["abxq", "zab", "", "a\0b\0\0", "語 aB", *marks]
    P, sizes = s.presence(texts)
    K = s.kernel(texts, P[5:].T / np.sqrt(sizes[5:]))
    for i, a in enumerate(texts):
        assert sizes[i] == len(grams(a.lower()))
        for j, b in enumerate(marks):
            shared = len(grams(a.lower()) & grams(b))
            assert P[i] @ P[5 + j] == shared and abs(K[i, j] - shared / np.sqrt(max(1, sizes[i]) * sizes[5 + j])) < 1e-6
    long = "".join(chr(97 + i * i % 23) for i in range(3 * op3_langid.PIECE + 5))
    assert len(op3_langid.grams(long)) == len(grams(long))


def test_language_regression():
    """Scores equal kernel ridge regression on exact Nystroem features, written from the formulas."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcde fg" if i % 2 else "fghij ab", k=rng.randint(1, 60))) for i in range(40)]
    langs = ["x" if i % 2 else "y" for i in range(40)]
    texts, langs = texts + ["zzz zz", "zz z"], [*langs, "w", "w"]
    m = op3_langid.fit(texts, langs, landmarks=12)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    k = lambda a, b: len(grams(a) & grams(b)) / np.sqrt(max(1, len(grams(a))) * max(1, len(grams(b))))
    marks = [t for n in ("w", "x", "y") for t in [t for t, x in zip(texts, langs, strict=True) if x == n][:4]]
    Z, C = np.array([[k(a, b) for b in marks] for a in marks]), np.array([[k(a, b) for b in marks] for a in texts])
    Y = np.array([[1.0 if x == n else -1.0 for n in ("w", "x", "y")] for x in langs])
    share = np.array([1 / langs.count(x) for x in langs])
    share /= share.mean()
    D, one = np.diag(share), np.ones((len(texts), 1))
    top = (share[:, None] * Y).sum(0) / share.sum()
    X = C - one * C.mean(0)
    W = np.linalg.solve(X.T @ D @ X + op3_langid.RIDGE * len(X) * Z, X.T @ D @ (Y - top))  # the same minimum in the landmarks' span
    want = C @ W + top - C.mean(0) @ W
    assert m.languages == ["w", "x", "y"] and np.abs(m.scores(texts) - want).max() < 1e-3


def test_language_stage(spark):
    """The set of languages, the least score and a missing model decide what stays; clashing columns do not."""
    df = language_rows(spark).select("*", *(F.lit(1).alias(c) for c in ("lang_pred", "score", "held_out", "share", "at")))
    model = op3_langid.train(df)
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in op3_langid.identify(df, model).collect()]
    for languages, least in ((None, 0.35), (("en",), 0.5), (None, 0.97), (("de", "fr"), 0.0), ((), 0.0)):
        want = [i for i, name, score in found if name != "und" and (languages is None or name in languages) and score >= least]
        kept = op3_langid.keep_identified(df, model, languages=languages, least=least)
        assert kept.columns == df.columns
        same([(r["doc_id"],) for r in kept.collect()], [(i,) for i in want])
    assert op3_langid.keep_identified(df, None).count() == df.count() - 3
    same([(r["doc_id"],) for r in op3_langid.language_id(df).collect()], [(i,) for i, _, _ in found])


def test_language_model(spark):
    df = documents(spark, 40)
    docs = [(i, (t or "").encode().lower().split(), out(i, 5)) for i, t in pairs(df)]
    U, B, n_docs = Counter(), Counter(), 0
    for _, w, held in docs:
        if not held:
            U.update([*w, "END"])
            B.update(zip(["START", *w], [*w, "END"], strict=True))
            n_docs += 1
    N, V = sum(U.values()), len(U)
    Z, a = N + 0.5 * (V + 1), op4_lm.STRENGTH / N  # P(w | h) = (c(h w) + a (c(w) + 1/2)) / (c(h) + a Z)
    want = {}
    for i, w, held in docs:
        tokens = [*w, "END"]
        base = sum(log10((U[t] + 0.5) / Z) for t in tokens)
        score = sum(log10(B[p, t] + a * (U[t] + 0.5)) - log10((n_docs if p == "START" else U[p]) + a * Z) for p, t in zip(["START", *w], tokens, strict=True))
        want.setdefault(i, []).append((held, len(tokens), sum(U[t] > 0 for t in tokens), N, base, score))
    rows = defaultdict(list)
    for r in op4_lm.score(df).collect():
        rows[r["doc_id"]].append(tuple(r)[1:])
    assert set(rows) == set(want)
    for i in want:
        for x, y in zip(sorted(rows[i]), sorted(want[i]), strict=True):
            assert x[:4] == y[:4] and x[4] == pytest.approx(y[4], abs=1e-8) and x[5] == pytest.approx(y[5], abs=1e-3 * (1 + len(docs)))
    assert op4_lm.score(df.limit(0)).count() == 0


def test_language_model_spreads_frequent_words(spark, monkeypatch):
    df = documents(spark, 30)
    whole = sorted((tuple(r) for r in op4_lm.score(df).collect()), key=str)
    monkeypatch.setattr(op4_lm, "FREQUENT", 0.001)
    monkeypatch.setattr(op4_lm, "CHUNK_TOKENS", 50)
    spread = sorted((tuple(r) for r in op4_lm.score(df).collect()), key=str)
    for x, y in zip(whole, spread, strict=True):
        assert x[:5] == y[:5] and x[5] == pytest.approx(y[5]) and x[6] == pytest.approx(y[6], abs=0.2)


def test_elias_fano():
    """Access and successor search on the compressed form against plain arrays."""
    rng = np.random.default_rng(1)
    for n, bits in ((1, 64), (1000, 64), (5000, 20), (500, 10), (3000, 1), (700, 45)):
        v = np.sort(rng.integers(0, 2**bits - 1, n, dtype=np.uint64, endpoint=True))
        e = EliasFano.build(v, bits)
        e = EliasFano.view(*e.parts())
        assert np.array_equal(e.access(np.arange(n)), v)
        asked = np.concatenate([v, np.minimum(v, np.uint64(2**bits - 2)) + np.uint64(1), rng.integers(0, 2**bits - 1, 500, dtype=np.uint64, endpoint=True)])
        place, met = e.successor(asked)
        assert np.array_equal(place, np.searchsorted(v, asked)) and np.array_equal(met, np.isin(asked, v))


def test_trie():
    """Every pair is found below its own history and nowhere else, from mapped bytes; counts beyond 32 bits stay."""
    rng = np.random.default_rng(2)
    histories = np.unique(rng.integers(0, 2**64 - 1, 300, dtype=np.uint64))
    ranks = rng.integers(0, len(histories) // 2, 4000).astype(np.uint64)  # the rest has no word
    keys = np.unique(ranks << np.uint64(40) | rng.integers(0, 50, 4000).astype(np.uint64))
    logs = -rng.random(len(keys)) * 6
    counts = np.arange(len(histories)) + 2**32 + 7
    trie = Trie.mapped(Trie.build(histories, counts, keys, logs).dump())
    assert np.array_equal(trie.rank(histories), np.arange(len(histories))) and (trie.rank(histories + np.uint64(1)) == -1).all()
    assert np.array_equal(trie.counts, counts)
    every = np.array([(r, c) for r in range(-1, len(histories)) for c in range(60)])
    places = trie.find(every[:, 0], every[:, 1].astype(np.uint64))
    known = dict(zip(keys.tolist(), logs.tolist(), strict=True))
    want = [10 ** known[r << 40 | c] if r >= 0 and r << 40 | c in known else 0 for r, c in every.tolist()]
    assert np.allclose(trie.probability(places), want, rtol=3e-4, atol=0)
    empty = Trie.mapped(Trie.build(histories[:0], counts[:0], keys[:0], logs[:0]).dump())
    assert (empty.rank(histories) == -1).all() and (empty.find(np.array([-1]), keys[:1]) == 0xFFFF).all()


PAGE = """<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>Menu</a><li>Other</ul></nav>
<div class="cookie-notice">We use cookies</div><div>Site {site}</div>{main}<div id="comments"><p>First!</div><form>Search <input></form><aside>Side</aside><footer>&copy; 2020</footer></body></html>"""


def test_html(spark):
    articles = [PAGE.format(site="X", main=f"<article><h1>Title {i}</h1><p>Shared   quote</p><p>Own&nbsp;text &amp; more {i}<br>line<p>Last {i}</article>") for i in range(3)]
    plain = [PAGE.format(site="Y", main=f"<p>Own line {i}</p><p>Second {i * 7}</p>") for i in range(3)]
    rows = [(i, f"http://h.org/a/{i}?q=1", p) for i, p in enumerate(articles)] + [(10 + i, f"http://p.org/a/{i}#x", p) for i, p in enumerate(plain)]
    rows += [(20, "http://e.org", ""), (21, None, None), (22, "http://b.org/x", "<p>broken <b>bold <p>next<div class='x'>tail"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "text") for r in rows], "page_id long, url string, html string, text string")
    got = defaultdict(list)
    for r in op5_html.extract(df).collect():
        assert r["n_chars"] == len(r["text"])
        got[r["page_id"]].append(r["text"])
    assert got[0] == ["Title 0\n\nShared quote\n\nOwn text & more 0 line\n\nLast 0"] * 2
    assert got[12] == ["Own line 2\n\nSecond 14"]
    assert got[20] == [""] and got[21] == [""] and got[22] == ["broken bold\n\nnext\n\ntail"]
    assert op5_html.extract(df.limit(0)).count() == 0


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_lines():
    rng = random.Random(2)
    for k in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        found = sorted(op5_html.shared(a, b, most=20 if k % 2 else op5_html.TABLE_BITS))  # 20 bits: halves
        assert len(found) == common_length(a, b)
        at = iter(b)
        assert all(a[i] in at for i in found)
    start = time.monotonic()
    assert len(op5_html.shared(["x"] * 20_000, ["x", "y"] * 10_000)) == 10_000
    assert time.monotonic() - start < 20


def test_html_against_brute_force(spark):
    """Hosts of pages without an article: lines that a longest common subsequence with the nearest URL shares go, whatever the ranges."""
    rng = random.Random(5)
    pages = []
    for i in range(120):
        host = rng.choice(["a.org", "a.org", "b.org", "c.org/x"])
        blocks = [rng.choice(["top bar", "site map", "terms"]) for _ in range(rng.randint(0, 4))] + [f"story {rng.randint(0, 9)}" for _ in range(rng.randint(1, 5))] + ["imprint"]
        pages.append((i, f"http://{host}/{rng.randint(0, 60)}", blocks))
    key = lambda p: (p[1][7:].split("/")[0], p[1][7:], p[1], p[0])
    ordered, want = sorted(pages, key=key), {}
    for i, p in enumerate(ordered):
        near = next((ordered[j] for j in (i - 1, i + 1) if 0 <= j < len(ordered) and key(ordered[j])[0] == key(p)[0]), None)
        best = common_length(p[2], near[2]) if near else 0
        want[p[0]] = (len(p[2]) - best, near)
    df = spark.createDataFrame([(i, u, "<body>" + "".join(f"<p>{b}</p>" for b in bs) + "</body>") for i, u, bs in pages], "page_id long, url string, html string")
    results = []
    for parts in (1, 4, 60):
        got = {r["page_id"]: r["text"] for r in op5_html.extract(df, partitions=parts).collect()}
        assert len(got) == len(pages)
        results.append(got)
    assert results[0] == results[1] == results[2]
    changed = 0
    for i, _, bs in pages:
        lines = results[0][i].split("\n\n") if results[0][i] else []
        left, near = want[i]
        if len(lines) == len(bs):  # nothing shared, or a copy of its neighbour
            gone = near and common_length(bs, near[2])
            assert not gone or sum(map(len, bs)) * op5_html.COPY <= sum(sorted(map(len, bs))[-gone:])
        else:
            changed += 1
            assert len(lines) == left
            rest = iter(bs)
            assert all(x in rest for x in lines)
    assert changed > 80


def test_html_parts():
    """What the markup decides: names inside and outside an article, many equal lines, very long pages."""
    text = lambda page, other=None: op5_html.main_text(op5_html.lines_of(page), op5_html.lines_of(other) if other else None)
    inner = '<p class="share-price">Up 3</p><div class="search-results">Found</div><p>A <span class="related">span</span></p>'
    assert text(f'<div class="menu-bar">Menu</div><article>{inner}<div class="ad">Buy</div><section class="comments"><p>First</p></section><nav>Next</nav></article><p>Outside</p>') == "Up 3\n\nFound\n\nA span"
    assert text(f"<article>{inner}</article>", f"<article>{inner}<p>More of a longer text than that</p></article>") == "Up 3\n\nFound\n\nA span"
    assert text("<div>Bar</div><p>Own words that no other page has</p>", "<div>Bar</div><p>Others</p>") == "Own words that no other page has"
    long = "<ul>" + "<li>same" * 30_000 + "</ul><p>own</p>"
    assert text(long, "<ul>" + "<li>same" * 100 + "</ul>").count("same") == 29_900
    assert len(text("<article><p>" + "word " * 2_000_000 + "</article>")) == 9_999_999
    assert text("") == "" and text("<article></article>") == ""


def test_html_names_never_take_the_text():
    """Words in attributes don't make articles vanish; compound names ask the neighbour; comments go whatever their size."""
    text = lambda page, other=None: op5_html.main_text(op5_html.lines_of(page), op5_html.lines_of(other) if other else None)
    whole = ['main class="content with-sidebar"', 'article class="post has-comments"', 'article id="notice-of-merger"', 'article data-share="1" class="story-social"', 'article class="notice"', 'div role="main" class="ad"', 'section itemprop="articleBody" class="widget"', 'article class="x" data-class="menu"']
    whole += ['div class="content has-sidebar"', 'div class="social-science"', 'div id="page-header-image-story"', 'div class="notice"']
    for tag in whole:
        page = f"<nav>Menu</nav><{tag}><h1>Head</h1><p>The story</p></{tag.split()[0]}><footer>Imprint</footer>"
        other = page.replace("The story", "Another tale").replace("Head", "Title")
        assert text(page) == text(page, other) == "Head\n\nThe story", tag
    body = '<div class="body"><p>Own story of the day</p><div class="cookie-notice"><p>We use cookies</p><p>{}</p></div></div>'
    assert text(body.format("Today")) == "Own story of the day\n\nWe use cookies\n\nToday"
    assert text(body.format("Today"), body.format("Monday").replace("Own", "Other")) == "Own story of the day"
    assert text('<article><p>Short</p><section class="comments">' + "<p>A long comment</p>" * 9 + "</section></article>") == "Short"
    assert text('<article><p>Short</p><article class="comment"><p>A long comment on it</p></article></article>') == "Short"
    assert text('<article class="promo"><p>Buy this now, it is cheap</p></article><article><p>Short</p></article>') == "Short"


def test_html_marked_pages_against_brute_force(spark):
    """Random pages of nested parts, with article and main elements that carry names of all kinds: the text is that of unmarked leaves in them."""
    rng = random.Random(8)
    names = ["post", "has-comments", "notice-board", "story-social", "content with-sidebar", "wide"]
    gone = ["nav", "footer", "aside", "form", 'div class="comments"', 'section class="share"', 'ul class="menu x"']

    def part(depth, kept, words):
        out = ""
        for _ in range(rng.randint(1, 3)):
            if depth and rng.random() < 0.5:
                tag = rng.choice([*gone, 'div class="lead"', "section", "blockquote"])
                out += f"<{tag}>{part(depth - 1, kept and tag not in gone, words)}</{tag.split()[0]}>"
            else:
                line = f"line {rng.randint(0, 10**6)} &amp; on"
                out += f"<p>{line}</p>"
                if kept:
                    words.append(line.replace("&amp;", "&"))
        return out

    rows, want = [], {}
    for i in range(200):
        words = []
        main = rng.choice(["article", "main"])
        body = "<p>" + "lead " * 200 + f"{i}</p>" + part(3, True, words)
        rows.append((i, f"http://h{i % 3}.org/{i}", f'<body class="menu">{part(1, False, words)}<{main} class="{rng.choice(names)}" id="{rng.choice(names)}">{body}</{main}>{part(1, False, words)}</body>'))
        want[i] = "\n\n".join([("lead " * 200 + str(i)), *words])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in op5_html.extract(df).collect()} == want


def test_toxicity(spark):
    rng = random.Random(8)
    clean, bad = "stone river green hill walk tree house cloud rain light".split(), ["vexnot", "gorblat"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = rng.choices(clean, k=rng.randint(5, 80)) + (rng.choices(bad, k=2) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(500, None), (501, ""), (None, "stone"), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS __text", "1 AS toxic")
    known = spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int")
    model = op6_toxicity.train(df, known)
    got = op6_toxicity.score(df, model).collect()
    assert len(got) == len(rows) and all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400)
    kept = op6_toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {500, 501, None, 1, 2, 3}
    nothing = op6_toxicity.train(df, known.limit(0))
    assert {r["score"] for r in op6_toxicity.score(df, nothing).collect()} == {0.5}


def test_shards(spark):
    df = documents(spark, 200)
    rows = op7_sharding.shard_documents(df, shards=24).collect()
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in rows], [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in pairs(df)])
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert [tuple(r) for r in sorted(rows, key=str)] == [tuple(r) for r in sorted(op7_sharding.shard_documents(df.repartition(5), shards=24).collect(), key=str)]
    assert op7_sharding.shard_documents(df.limit(0)).count() == 0
    all_of_it = op7_sharding.shuffle_to_shards(df, ["doc_id", "text"], shards=3)
    assert all_of_it.columns == [c for c in df.columns if c != "shard"] + ["shard", "slot"] and all_of_it.count() == df.count()


def test_communication_matrix():
    for rows, sizes in (([5, 0, 7], [4, 4, 4]), ([0], [0, 0]), ([100] * 10, [334, 333, 333])):
        m = op7_sharding.matrix(rows, sizes, 1)
        assert [sum(r) for r in m] == rows and [sum(c) for c in zip(*m, strict=True)] == sizes
    rng = np.random.default_rng(0)
    draws = [op7_sharding.search_draw(30, 70, 20, float(u)) for u in rng.random(4000)]
    assert np.mean(draws) == pytest.approx(6, abs=0.15) and np.var(draws) == pytest.approx(20 * 0.3 * 0.7 * 80 / 99, rel=0.1)
    large = op7_sharding.search_draw(10**10, 10**11, 10**6, 0.5)
    assert abs(large - 10**6 / 11) < 2000
    with pytest.raises(ValueError):
        op7_sharding.matrix([1], [2], 0)


def test_toxicity_ratios_and_fit():
    """Log-count ratios counted in plain sets, and a fit at which the penalised loss has no slope."""
    rng = random.Random(12)
    clean, bad = "stone river green hill walk tree house cloud".split(), ["vexnot", "gorblat"]
    texts = [" ".join(rng.choices(clean, k=rng.randint(2, 20)) + rng.choices(bad, k=i % 3 == 0)) for i in range(150)]
    labels = [int(i % 3 == 0) for i in range(150)]
    model = op6_toxicity.fit(texts, labels)

    def bucket(gram):  # the same hash, one n-gram at a time
        h = ord(gram[0])
        for c in gram[1:]:
            h = (h * 0x9E3779B1 + ord(c)) & 0xFFFFFFFF
        return ((h ^ (h >> 15) ^ len(gram)) * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - op6_toxicity.BITS)

    sets = [{bucket(f" {t} "[i : i + n]) for n in range(2, 7) for i in range(len(t) + 3 - n)} for t in texts]
    p, q = (Counter(b for own, y in zip(sets, labels, strict=True) if y == side for b in own) for side in (1, 0))
    m = op6_toxicity.SMOOTH
    ratio = {b: np.log((p[b] + m) / (50 + 2 * m)) - np.log((q[b] + m) / (100 + 2 * m)) for b in set(p) | set(q)}
    kept = sorted(b for b, v in ratio.items() if p[b] + q[b] >= op6_toxicity.LEAST_TEXTS and abs(v) >= op6_toxicity.LEAST_Z * np.sqrt(1 / (p[b] + m) + 1 / (q[b] + m)))
    assert model.kept.tolist() == kept and kept
    X = np.array([[ratio[b] if b in own else 0.0 for b in kept] for own in sets])
    w = model.weights / np.array([ratio[b] for b in kept])
    miss = 1 / (1 + np.exp(-(X @ w + model.intercept))) - np.array(labels)
    slope = np.append(X.T @ miss + op6_toxicity.PENALTY * w, miss.sum())
    assert np.abs(slope).max() < 0.05
    assert np.allclose(model.scores(texts), 1 / (1 + np.exp(-(X @ w + model.intercept))), atol=1e-9)


def test_very_long_texts(spark):
    """A document of many distinct words and one of a single pair, beside short ones: all tokens count."""
    long, same_pair = " ".join(f"w{i}" for i in range(400_000)), "to be " * 200_000
    df = spark.createDataFrame([(2, long), (3, same_pair), (4, "to be"), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in op4_lm.score(df).collect()}
    assert [got[i]["n_tokens"] for i in (2, 3, 4, 5)] == [400_001, 400_001, 3, 1]
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got.values())
    ids = {r["doc_id"]: r["n_words"] for r in op9_decontamination.contamination(df, spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string")).collect()}
    assert ids == {2: 400_000, 3: 400_000, 4: 2, 5: 0}


def test_gif_round_trip(spark):
    df = documents(spark)
    want = []
    for i, t in pairs(df):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    rows = op8_gif.store_texts(df, keep_media=True).collect()
    same([tuple(r)[:5] for r in rows], want)
    assert all(r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() for r in rows)
    texts = defaultdict(list)
    for i, t in pairs(df):
        texts[i].append(t)
    for r in rows:
        raw = (texts[r["doc_id"]][0] or "").encode()
        counts = Counter()
        for b in raw + b"\0" * (r["payload_bytes"] - len(raw)):  # three bits of red, three of green, two of blue; two of each are told apart
            counts[(b >> 6) * 16 + ((b >> 2 & 7) >> 1) * 4 + (b & 3)] += 1
        want_colours = [counts[k] for k in range(64)]
        assert r["feature"] == f"frames=1;ms=100;rgb64={','.join(map(str, want_colours))}"
        assert [(f["frame"], f["start_ms"], f["delay_ms"], f["height"], f["histogram"]) for f in r["frames"]] == [(0, 0, 100, r["payload_bytes"] // 64, want_colours)]
    assert op8_gif.store_texts(df.limit(0)).count() == 0
    long = bytes(random.Random(1).randrange(256) for _ in range(64 * 70_000 // 64 * 64))
    frames = list(op8_gif.decode(op8_gif.encode_samples(long), compose=False))
    assert len(frames) == 2 and b"".join(f.samples.tobytes() for f in frames) == long
    row, media = op8_gif.store_text("y" * (64 * 65_535 + 1))
    assert row[1] == 64 * 65_536 and [sum(f["histogram"]) for f in row[7]] == [64 * 65_535, 64] and row[7][1]["start_ms"] == 100
    assert media == op8_gif.encode_samples(b"y" * (64 * 65_535 + 1) + b"\0" * 63)


def test_lzw_streams():
    rng = random.Random(3)
    for size in range(2, 9):
        for n in (0, 1, 2, 500, 30_000):
            p = bytes(rng.randrange(1 << size) for _ in range(n))
            assert op8_gif.lzw_decode(op8_gif.lzw_encode(p, size), size) == p
    assert op8_gif.lzw_decode(op8_gif.lzw_encode(b"\1" * 50_000), 8) == b"\1" * 50_000
    with pytest.raises(ValueError):
        op8_gif.lzw_decode(op8_gif.pack_codes(np.array([256, 65, 400]), np.array([9, 9, 9])), 8)


def test_gif_frames(spark):
    def frame(disposal, transparent, box, samples, interlace=False):
        x, y, w, h = box
        return b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None)]) + (5).to_bytes(2, "little") + bytes([transparent or 0, 0]) + b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, w, h)) + bytes([0x40 * interlace]) + b"\x02" + op8_gif.sub_blocks(op8_gif.lzw_encode(bytes(samples), 2))

    head = b"GIF89a" + (2).to_bytes(2, "little") + (2).to_bytes(2, "little") + b"\xf1\0\0" + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    gif = head + frame(1, None, (0, 0, 2, 2), [1, 1, 1, 1]) + frame(2, 0, (0, 0, 2, 1), [2, 0]) + frame(3, None, (1, 1, 1, 1), [3]) + frame(0, 0, (0, 0, 2, 2), [0, 0, 0, 2], True) + b"\x3b"
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    want = [[red, red, red, red], [green, red, red, red], [none, none, red, blue], [none, none, red, green]]
    got = [[tuple(p) for p in f.canvas.reshape(-1, 4).tolist()] for f in op8_gif.decode(gif)]
    assert got == want
    wide = b"GIF89a" + b"\xff" * 4 + gif[10:]
    body = head + b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (0, 0, 2, 2)) + b"\0"
    broken = [wide, body + b"\xff\x01\x00\x00", body + b"\x0d\x01\x00\x00", body + b"\x02" + op8_gif.sub_blocks(op8_gif.pack_codes(np.array([6, 6, 6]), np.array([3, 3, 3])))]
    rng = random.Random(9)
    broken += [bytes(rng.randrange(256) if rng.random() < 0.1 else b for b in gif) + b"!" for _ in range(40)]
    df = spark.createDataFrame([("a", gif), ("b", None), ("c", b"GIF89a"), ("d", gif[:60]), *((f"d{i}", x) for i, x in enumerate(broken))], "name string, pic binary")
    rows = op8_gif.decode_gifs(df, id_col="name", gif_col="pic").collect()
    assert [r["start_ms"] for r in rows if r["id"] == "a"] == [0, 50, 100, 150]
    assert {r["id"] for r in rows} == {"a", "b", "c", "d", *(f"d{i}" for i in range(len(broken)))}
    assert {"b", "c", "d", "d0", "d1", "d2", "d3"} <= {r["id"] for r in rows if r["error"]} and not any(r["error"] for r in rows if r["id"] == "a")
    assert next(r for r in rows if r["id"] == "a")["histogram"][48] == 4


def brute_contamination(docs, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s : s + 10])].add(item)
    result = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for win, own in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found |= {str(x) for x in own if x is not None}
        result.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return result


def test_contamination(spark):
    rng = random.Random(6)
    vocabulary = ["the", "of", "Ä", "é", "K", "x1", "stone", "river", "Green"]
    items = [(i, " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate([14, 10, 9, 2, 1, 30])] + [(90, None), (91, "..."), (92, "of of of of of of of of of of of"), (93, "of of of of of of of of of of of"), (None, "lonely words")]
    docs = []
    for i in range(60):
        own = rng.choices(vocabulary[:7] if i % 2 else ["pq", "rs", *vocabulary[:3]], k=rng.choice([0, 5, 50, 200]))
        if i % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = (rng.choice(items)[1] or "").upper().split()
        docs.append((i % 50, ", ".join(own)))
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, "of " * 40), (203, "x Of OF of-of:of OF of of of of of of z"), (0, docs[0][1]), (204, "lonely words")]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, window int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in op9_decontamination.contamination(df, bench).collect()]
    want = brute_contamination(docs, items)
    same(got, want)
    kept = op9_decontamination.keep_clean(df, bench)
    assert kept.columns == df.columns
    same([(r["doc_id"], r["text"]) for r in kept.collect()], [d for d, w in zip(docs, want, strict=True) if not w[5]])
    assert not any(r["contaminated"] for r in op9_decontamination.contamination(df, bench.limit(0)).collect())
    assert op9_decontamination.contamination(df.limit(0), bench).count() == 0


def test_proximity(spark):
    windows = spark.createDataFrame([(1, ["alpha", "beta", "gamma"])], "window long, words array<string>")
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "alpha x x x x beta gamma gamma gamma")], "doc_id long, text string")
    terms = op9_decontamination.terms_of(windows)
    found = op9_decontamination.proximity_matches(op9_decontamination.index(df, terms), terms, 1)
    assert {(r["doc_id"], r["distance"]) for r in found.collect()} == {(1, 0), (2, 1)}


def test_packing(spark):
    df = documents(spark, 80)
    path = tokenizer("word_bpe_49k.json")
    lib = load(path)
    rows = op10_packing.pack(df, path, window=256).collect()
    ids = defaultdict(list)
    for i, t in pairs(df):
        ids[i].append(lib.encode(t or "", add_special_tokens=False).ids + [1])
    assert sum(r["length"] for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for r in rows:
        part = [np.array(x[r["start"] : r["start"] + r["length"]], "<u4") for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert r["ids_crc32"] in {zlib.crc32(p.tobytes()) for p in part}
    starts = defaultdict(list)
    for r in rows:
        starts[r["doc_id"]].append((r["start"], r["length"]))
    for i, v in starts.items():
        if len(ids[i]) == 1:
            assert [a for a, _ in sorted(v)] == list(range(0, len(ids[i][0]), 256))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 256
    assert op10_packing.pack(df.limit(0), path).count() == 0


def test_histogram_plan():
    rng = np.random.default_rng(5)
    for bins, n in ((32, 0), (32, 7), (64, 5000), (256, 20_000)):
        h = np.bincount(rng.integers(1, bins + 1, n), minlength=bins + 1)
        patterns = op10_packing.plan(h)
        used = np.zeros(bins + 1, int)
        for p, times in patterns:
            assert sum(p) <= bins and times > 0
            for b in p:
                used[b] += times
        assert np.array_equal(used, h)
        if n >= 5000:
            total = (h * np.arange(bins + 1)).sum()
            assert total / (bins * sum(t for _, t in patterns)) > 0.99


def test_nnls():
    rng = np.random.default_rng(9)
    columns = op10_packing.combinations(16)
    target = rng.integers(0, 50, 17).astype(float)
    target[0] = 0
    x = op10_packing.nnls(columns, target)
    A = np.array([np.bincount(c, minlength=17) for c in columns]).T.astype(float)
    A[0] = 0
    gradient = A.T @ (target - A @ x)
    assert (x >= 0).all() and gradient.max() < 1e-5 and np.abs(gradient[x > 0]).max() < 1e-5

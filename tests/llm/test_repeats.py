"""Spelling variants, collocations and repeated passages against brute force on small inputs with nulls, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from terrachron.llm import op11_spelling, op12_collocations, op13_substrings


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def table(spark, rows):
    """Extra columns have the operators' own names."""
    return spark.createDataFrame([(d, t, lang, 1, "x", 2, 3) for d, t, lang in rows], "doc_id long, text string, lang string, n int, word string, a int, start int").repartition(3)


def made_texts(seed=1, n=150):
    rng = random.Random(seed)
    syllables = ["ber", "ost", "änd", "Ing", "the", "ra", "lo", "né"]
    words = ["".join(rng.choices(syllables, k=rng.choice([1, 3, 4]))) for _ in range(60)]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b"]
    text = lambda k: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(k))
    passage = text(45)
    rows = [(i, text(rng.choice([0, 5, 30, 200])), rng.choice(["de", "en", None])) for i in range(n)]
    rows += [(n + i, text(10) + passage + text(rng.choice([0, 15])), "en") for i in range(30)]
    rows += [(300 + i, "one long copy " * 30, "en") for i in range(20)] + [(400, None, None), (401, "", "en"), (402, " \t", "en"), (None, passage, "en"), (None, passage + " more", "en"), (5, passage, "de"), (5, passage, "de"), (6, "x" * 50_000 + " " + passage, "de")]
    rows += [(500, text(6_000), "de")]
    return [(d, t, lang) for d, t, lang in rows]


def brute_words(rows, shortest=7, least=2, ratio=10):
    counts = Counter()
    for d, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", low(t)):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            counts[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]

    nears = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, own in nears.items():
        if own and counts[best := min(own, key=lambda x: (-counts[x], x))] >= ratio * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(nears[w]), counts[form[w]] if w in form else None))
    return Counter(out)


def test_spelling_variants(spark):
    rows = made_texts()
    rows += [(600, "streeet " * 2 + "streeets " * 20 + "streests " * 200 + "streestz " * 2 + "xstreestz " * 2, "en"), (601, "aaaaaaab baaaaaaa aaaaaaab baaaaaaa bbaaaaaa bbaaaaaa aaaaaaaa aaaaaaaa", "en")]
    got = Counter(map(tuple, op11_spelling.spelling_variants(table(spark, rows)).collect()))
    assert got == brute_words(rows)
    assert any(f and f != root for _, f, root, *_ in got), "no chain of forms"
    got = op11_spelling.spelling_variants(table(spark, rows), shortest=4, least=1, ratio=3).collect()
    assert Counter(map(tuple, got)) == brute_words(rows, 4, 1, 3)
    assert op11_spelling.spelling_variants(table(spark, rows[:1]).limit(0)).count() == 0


def test_near_words_share_a_signature():
    rng = random.Random(4)
    letters = "abcdé"
    for _ in range(2_000):
        word = "".join(rng.choices(letters, k=rng.randint(2, 12)))
        i, kind, c = rng.randrange(len(word)), rng.randrange(3), rng.choice(letters)
        other = [word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + c + word[i:]][kind]
        if other != word and len(other) > 1:
            least = min(len(word), len(other))
            assert set(op11_spelling.signatures(word, least)) & set(op11_spelling.signatures(other, least))


def brute_collocations(rows, longest, least, top, share):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    gone = {(lang, p[i : i + m]) for (lang, p), v in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * v >= share * found[lang, p[i : i + m]]}
    by = {}
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            by.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, own in by.items() for r, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


@pytest.mark.parametrize(("known", "tile", "held"), [(400_000, 1_024, 3_000_000), (7, 4, 50), (40, 2, 500)])
def test_collocations(spark, monkeypatch, known, tile, held):
    """Levels that tasks know whole and such that they know in part give the same."""
    monkeypatch.setattr(op12_collocations, "KNOWN", known)
    monkeypatch.setattr(op12_collocations, "KNOWN_ITEMS", known)
    monkeypatch.setattr(op12_collocations, "TILE", tile)
    monkeypatch.setattr(op12_collocations, "HELD", held)
    rows = made_texts(2)
    got = sorted(map(tuple, op12_collocations.collocations(table(spark, rows), least=5, top=40).collect()))
    assert got == brute_collocations(rows, 4, 5, 40, 80)
    assert {r[0] for r in got} == {"de", "en", "und"} and {len(r[2].split(" ")) for r in got} == {2, 3, 4}
    if known == 7:
        assert op12_collocations.collocations(table(spark, rows), least=10**6).count() == 0
        assert op12_collocations.collocations(table(spark, rows).limit(0)).count() == 0


def test_tiles_count_what_coordinates_count():
    rng = np.random.default_rng(1)
    first, second = (np.minimum(rng.zipf(1.3, 5_000), 900) - 1 for _ in range(2))
    want = Counter(zip(first.tolist(), second.tolist(), strict=True))
    for tile in (1, 7, 64, 1_024):
        keys, ns = op12_collocations.count_cells(first, second, tile)
        assert Counter(dict(zip(zip((keys // op12_collocations.SIDE).tolist(), (keys % op12_collocations.SIDE).tolist(), strict=True), ns.tolist(), strict=True))) == want
        assert len(set(keys.tolist())) == len(keys)


def brute_removals(rows, size):
    first, docs = {}, [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t, _ in rows]
    place = lambda d, i: (d is None, d or 0, i)
    for d, words in docs:
        for i in range(len(words) - size + 1):
            own = tuple(words[i : i + size])
            first[own] = min(first.get(own, place(d, i)), place(d, i))
    out = Counter()
    for d, words in docs:
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            if first[tuple(words[i : i + size])] < place(d, i):
                gone[i : i + size] = [True] * size
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[d, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("held", "size"), [(1_000_000, 20), (60, 20), (500, 13), (500, 31)])
def test_removals(spark, monkeypatch, held, size):
    monkeypatch.setattr(op13_substrings, "HELD", held)
    rows = made_texts(3)
    got = Counter(map(tuple, op13_substrings.removals(table(spark, rows), window=size).collect()))
    assert got == brute_removals(rows, size)
    assert sum(r[2] for r in got) > 1_000
    if held == 60:
        assert op13_substrings.removals(table(spark, rows).limit(0)).count() == 0
        with pytest.raises(ValueError):
            op13_substrings.removals(table(spark, rows), window=12)


def test_cover_meets_every_difference():
    period, cover = op13_substrings.PERIOD, op13_substrings.COVER
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))

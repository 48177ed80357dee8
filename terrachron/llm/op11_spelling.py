"""Spelling variants: words at one insertion, deletion or replacement of a letter, found through PartEnum signatures.

A word's letters are a multiset; with each letter's repeats numbered it is a binary vector over (letter, repeat). One
edit moves at most two of its places, so near words are vectors at a Hamming distance of at most two. The places are
dealt into ``PARTS`` parts. Two vectors that differ at two places at most are equal on all parts but two, so they
share one of the signatures made of every choice of ``PARTS - 2`` parts: no near pair is lost. One edit also leaves
the first or the last half of the shorter word as it is, and lengths differ by one at most. So a signature is kept for
each length and either half, which parts the common ones. Words of a signature meet in an equi-join whose condition is
the edit distance: pairs that are not near are not rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrachron.llm.common import by_bytes, drop_stored, prepare, release, stored, text_of

SHORTEST, LEAST, RATIO = 7, 2, 10
#: Of a run whose checksum with its document's id this divides, one letter is left out.
SLIP = 31
PARTS = 4
#: Words that a task holds, bytes of text that it takes at a time.
WORDS, PIECE = 300_000, 4 << 20
#: Steps of doubled pointers. Counts grow tenfold a step along forms, so a chain of 64-bit counts has 19 at most.
DOUBLINGS = 5


def slipped(word: str, doc_id: int | None) -> str:
    """The word, without one letter if the rule says so; a null id counts as an empty text."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    return word if h % SLIP else word[: h % len(word)] + word[h % len(word) + 1 :]


def vocabulary(texts: DataFrame, *, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of words of ``shortest`` letters or more with ``least`` occurrences or more, from (doc_id, text)."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{shortest},}}")  # a slip shortens, so shorter runs can't become words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        rows_of = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)
        for batch in by_bytes(batches, PIECE):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in Counter(runs.findall(text.encode().lower().decode())).items():  # of bytes, lower() folds A-Z alone
                    word = slipped(word, doc_id)
                    if len(word) >= shortest:
                        counts[word] += n
            if len(counts) > WORDS:
                yield rows_of()
                counts.clear()
        yield rows_of()
        release()

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def places_by_part(word: str, parts: int = PARTS) -> list[str]:
    """The places at which a word's vector is one, its letters with the number of their repeat, as a text a part."""
    out, last, repeat = [""] * parts, "", 0
    for letter in sorted(word):
        repeat = repeat + 1 if letter == last else 0
        last = letter
        out[(ord(letter) * 40_503 + repeat * 30_011 >> 7) % parts] += f"{letter}{repeat}"
    return out


def signatures(word: str, length: int, parts: int = PARTS) -> list[int]:
    """Every choice of all parts but two, each with the first and with the last half of ``length`` letters, as unsigned 64-bit hashes."""
    from xxhash import xxh64_intdigest

    own, half = places_by_part(word, parts), length // 2
    edges = f"{length}^{word[:half]}", f"{length}${word[-half:]}"
    chosen = ["|".join([str(c), *(own[p] for p in c)]) for c in combinations(range(parts), max(1, parts - 2))]
    return [xxh64_intdigest(f"{c}|{e}") for c in chosen for e in edges]


def signed(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(signature, longer, word, n): the signatures of each word's own length and, longer, of one letter less."""
    schema = pa.schema([("signature", pa.int64()), ("longer", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2_000):
                some = batch.slice(i, 2_000)
                each = [[signatures(w, length, parts) for length in (len(w), len(w) - 1)] for w in some.column(0).to_pylist()]
                found = np.array([s for two in each for own in two for s in own], np.uint64).view(np.int64)
                many = len(found) // max(1, 2 * some.num_rows)
                at = pa.array(np.repeat(np.arange(some.num_rows), 2 * many))
                longer = np.tile(np.repeat([False, True], many), some.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(longer), some.column(0).take(at), some.column(1).take(at)], schema=schema)
        release()

    return words.select("word", "n").mapInArrow(run, "signature long, longer boolean, word string, n long")


def near_pairs(words: DataFrame, *, parts: int = PARTS) -> DataFrame:
    """(word, n, other, other_n): each pair of near words of two letters or more once, the shorter or smaller first."""
    all_of = signed(words, parts)
    a, b = all_of.where("NOT longer").alias("a"), all_of.alias("b")
    near = (F.col("a.signature") == F.col("b.signature")) & (F.col("b.longer") | (F.col("a.word") < F.col("b.word"))) & (F.levenshtein("a.word", "b.word", 1) == 1)
    return a.join(b, near).select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that forms reach."""
    ends = forms.select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(ends.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not after.where("moved").isEmpty()
        ends = after.drop("moved")
        if not moved:
            break
    return ends


def spelling_variants(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``shortest`` letters or more that occurs ``least`` times or more.

    form is the near word of greatest n (ties: the smallest), if that is ``ratio`` times the word's own n or more, root
    the last of the forms from the word on, or itself. Words are maximal runs of the letters of ASCII and Latin-1,
    A-Z folded. Null texts have no words; a null id counts as an empty text in the rule of slips. Repeated rows count
    each time. A table without words gives an empty one. Other columns are not read.
    """
    prepare(df.sparkSession)
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).where("text <> ''")
    words = stored(vocabulary(texts, shortest=shortest, least=least), "words")
    pairs = stored(near_pairs(words), "pairs")
    turned = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = pairs.unionByName(turned).groupBy("word").agg(F.count("*").alias("n_near"), F.any_value("n").alias("own"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    best = best.select("word", "n_near", F.when(-F.col("best.less") >= ratio * F.col("own"), F.struct("best.form", (-F.col("best.less")).alias("n"))).alias("best"))
    best = stored(best.select("word", "n_near", F.col("best.form").alias("form"), F.col("best.n").alias("form_n")), "forms")
    drop_stored(pairs)
    found = words.join(best, "word", "left").join(roots(best.where("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")

"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

Postings (term, document, position) of every token whose term occurs in the test items are stored once. For each
distinct test window the terms are ranked by the length of their posting lists. Candidates come from the rarest
term's list, moved back by its offset, and are intersected with the second rarest's; what is left is intersected
with the lists of all other terms at once, and only places where every offset is met are matches. Nothing is dropped
or capped: a window of common words alone costs what its rarest list holds.

The windows and terms are as many as the test items make. They, and the candidate documents, are broadcast only if
they are counted at no more than ``BROADCAST_ROWS`` rows; else they are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrachron.llm.common import LOWER, UPPER, drop_stored, free_name, prepare, stored, text_of

#: Characters that part words: all ASCII but digits and letters.
PARTS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WINDOW, BROADCAST_ROWS = 10, 200_000


def small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast, if it has few enough rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def words(text: Column) -> Column:
    """The words of a text in its own case; empty for none. A part before the first word is cut off."""
    return F.filter(F.split(text, PARTS), lambda w: w != "")


def fold(word: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(word, UPPER, LOWER)


def document_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, part (a hash of the text, so that rows that share an id stay apart) and text."""
    text = text_of(text_col)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("part"), text.alias("text"))


def windows_of(items: DataFrame, *, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, item_id, words): each distinct window of an item's folded words; shorter items are one window.

    window is the window's words in one text; ``numbered`` makes it a number.
    """
    own = items.select(F.col(id_col).cast("string").alias("item_id"), words(fold(text_of(text_col))).alias("__words")).where(F.size("__words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("__words") - size, F.lit(0)))
    each = own.select("item_id", "__words", F.explode(starts).alias("__at")).select("item_id", F.slice("__words", F.col("__at") + 1, size).alias("words"))
    return each.select(F.concat_ws(" ", "words").alias("window"), "item_id", "words").distinct()


def numbered(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(window, item_id) and (window, words), each distinct window with a number; both come from written tables."""
    distinct = stored(windows.dropDuplicates(["window"]).select(F.monotonically_increasing_id().alias("number"), "window", "words"), "windows")
    items = stored(windows.join(distinct.select("window", "number"), "window").select(F.col("number").alias("window"), "item_id"), "items")
    return items, distinct.select(F.col("number").alias("window"), "words")


def terms_of(windows: DataFrame) -> DataFrame:
    """(window, offset, term, length) of each distinct window (window, words)."""
    return windows.select("window", F.size("words").alias("length"), F.posexplode("words").alias("offset", "term"))


def index(df: DataFrame, terms: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (term, doc_id, part, position) of ``df``'s tokens whose folded form is in ``terms``."""
    keyed = document_key(df, id_col, text_col)
    tokens = keyed.select("doc_id", "part", F.posexplode(words(F.col("text"))).alias("position", "__word"))
    # a fold of all letters joins cheaply; folds that differ outside A-Z are told apart on the few rows that join
    wanted = terms.select("term").distinct().select("term", F.lower("term").alias("__lower"))
    met = tokens.withColumn("__lower", F.lower("__word")).join(small(wanted), "__lower").where(fold(F.col("__word")) == F.col("term"))
    return met.select("term", "doc_id", "part", "position")


def ranked(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """``terms`` with rank: 1 for the window's rarest term. Windows with a term without postings are left out."""
    counts = stored(postings.groupBy("term").agg(F.count("*").alias("postings")), "counts")
    by = Window.partitionBy("window")
    joined = terms.join(small(counts), "term", "left").withColumn("__least", F.min(F.coalesce("postings", F.lit(0))).over(by)).where("__least > 0")
    return joined.withColumn("rank", F.row_number().over(by.orderBy("postings", "term", "offset"))).drop("__least")


def phrase_matches(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, part, start, window, length): every place where a window's words stand in a row."""
    lists = ranked(terms, postings)
    lists = stored(lists, "terms")

    def at(rank: Column) -> DataFrame:
        """Where a window would start for each posting of its terms of that rank."""
        return postings.join(small(lists.where(rank)), "term").select("window", "doc_id", "part", (F.col("position") - F.col("offset")).alias("start"))

    place = ["window", "doc_id", "part", "start"]
    null_safe = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c == "doc_id" else F.col(f"a.{c}") == F.col(f"b.{c}") for c in place]
    first, second = (at(F.col("rank") == k).where("start >= 0") for k in (1, 2))
    both = first.alias("a").join(second.alias("b"), null_safe, "left_semi").unionByName(at((F.col("rank") == 1) & (F.col("length") == 1)))
    lengths = lists.select("window", "length").distinct()
    found = stored(both.distinct().join(small(lengths), "window"), "candidates")
    documents = found.select("doc_id", "part").distinct()
    same = [F.col("p.doc_id").eqNullSafe(F.col("d.doc_id")), F.col("p.part") == F.col("d.part")]
    there = postings.alias("p").join(small(documents).alias("d"), same, "left_semi").select("p.*")
    needed = found.alias("f").join(lists.where("rank > 2").alias("l"), F.col("f.window") == F.col("l.window")).select("f.window", "f.length", "f.doc_id", "f.part", "f.start", "l.term", (F.col("f.start") + F.col("l.offset")).alias("position"))
    exact = [F.col("n.doc_id").eqNullSafe(F.col("p.doc_id")), *(F.col(f"n.{c}") == F.col(f"p.{c}") for c in ("part", "position", "term"))]
    rest = needed.alias("n").join(there.alias("p"), exact, "left_semi").groupBy("window", "doc_id", "part", "start", "length").agg(F.countDistinct("position").alias("met"))
    whole = rest.where(F.col("met") == F.col("length") - 2).drop("met")
    return whole.unionByName(found.where("length <= 2").select(*whole.columns))


def proximity_matches(postings: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """(doc_id, part, window, start, distance): places where a window's two rarest terms stand at most ``slop`` off their distance.

    start is where the rarest term puts the window; windows of one word have no proximity match.
    """
    lists = ranked(terms, postings)
    sides = [lists.where(F.col("rank") == r).join(postings, "term").select("window", "doc_id", "part", (F.col("position") - F.col("offset")).alias("start"), F.floor((F.col("position") - F.col("offset")) / F.lit(slop + 1)).alias("cell")) for r in (1, 2)]
    near = sides[1].withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    on = [F.col("a.window") == F.col("b.window"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.part") == F.col("b.part"), F.col("a.cell") == F.col("b.cell"), F.abs(F.col("a.start") - F.col("b.start")) <= slop]
    met = sides[0].alias("a").join(near.alias("b"), on).select("a.doc_id", "a.part", "a.window", "a.start", F.abs(F.col("a.start") - F.col("b.start")).alias("distance"))
    return met.groupBy("doc_id", "part", "window", "start").agg(F.min("distance").cast("int").alias("distance"))


def contamination(df: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``df``.

    A word is hit if it lies in any occurrence of a window of any item. Null texts have no words; a document without
    a match has the checksum of an empty list. Null, repeated and shared ids each give their own row; without items
    nothing is hit. Null item ids take no part in the list of items, but their words hit. Other columns are not read.
    """
    prepare(df.sparkSession)
    item_windows, windows = numbered(windows_of(items, size=size, id_col=item_col, text_col=item_text_col))
    terms = terms_of(windows)
    postings = stored(index(df, terms, id_col=id_col, text_col=text_col), "postings")
    matches = stored(phrase_matches(postings, terms), "matches")
    drop_stored(postings)
    key = ["doc_id", "part"]
    spans = matches.groupBy(*key, "start").agg(F.max("length").alias("length"))
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    hits = spans.withColumn("__end", F.coalesce(F.max(end).over(before), F.lit(0))).groupBy(*key).agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "__end"))).alias("n_hit"))
    item_lists = matches.select(*key, "window").distinct().join(item_windows, "window").groupBy(*key).agg(F.collect_set("item_id").alias("items"), F.count_distinct("item_id").alias("n_items"))
    found = hits.alias("h").join(item_lists.alias("i"), [F.col("h.doc_id").eqNullSafe(F.col("i.doc_id")), F.col("h.part") == F.col("i.part")], "left").select("h.*", "i.items", "i.n_items")
    rows = document_key(df, id_col, text_col).select("doc_id", "part", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.alias("r").join(found.alias("f"), [F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")), F.col("r.part") == F.col("f.part")], "left")
    n_hit = F.coalesce("f.n_hit", F.lit(0)).cast("long")
    listed = F.concat_ws(",", F.sort_array(F.coalesce("f.items", F.array().cast("array<string>"))))
    return joined.select("r.doc_id", "r.n_words", n_hit.alias("n_hit"), F.coalesce("f.n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_clean(df: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """The rows of ``df``, with all their columns, in which no window of any item occurs; null texts and ids as in ``contamination``."""
    prepare(df.sparkSession)
    _, windows = numbered(windows_of(items, size=size, id_col=item_col, text_col=item_text_col))
    terms = terms_of(windows)
    postings = stored(index(df, terms, id_col=id_col, text_col=text_col), "postings")
    matches = phrase_matches(postings, terms)
    own_id, own_part = free_name(df, "__id"), free_name(df, "__part")
    go = stored(matches.select(F.col("doc_id").alias(own_id), F.col("part").alias(own_part)).distinct(), "contaminated")
    drop_stored(postings)
    return df.join(small(go), F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text_of(text_col)) == F.col(own_part)), "left_anti")

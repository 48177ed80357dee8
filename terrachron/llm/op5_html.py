"""Main text of pages by nearest-URL differencing, held in check by the markup.

Pages are dealt out by ranges of host, URL path and id, so a host of any size is spread; a range also reads the pages
next to it, so that each page meets its neighbour in the order of paths, whose template it most likely shares. Each
page's lines (blocks of text) are aligned with its neighbour's by longest common subsequence, and shared lines are
deleted. The markup corrects what the verdict cannot know: lines in menus, headers, footers, sidebars, notices,
adverts, forms and comments go although no neighbour shares them, and lines of an article or main element stay
although one does, since articles quote each other, but for parts of theirs that a name of several words questions: of
those the differencing decides. On a page with such an element all other lines go; without one it decides on all. Pages that are copies of their neighbour, with most of
their text shared, lose nothing.

A class, id or role marks a part only by a whole name, and never a part that holds most of the text (comments aside).
A name of several words, such as cookie-notice or has-sidebar, only raises a question: the part
goes if the neighbour shares half of its lines. No name takes an article or main element away: one that a whole name
marks counts as a part where it lies in another, and as less than any other else.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrachron.llm.common import by_bytes, prepare

#: Elements whose content is not text of the page, parts of a page that are not its main text, blocks, and words of class, id and role that mark such parts.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "object", "select", "canvas", "audio", "video")
PARTS = frozenset("head nav header footer aside form menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
COMMENTS = frozenset("comment comments comentarios commentaires kommentare replies disqus".split())
MARKS = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs cookie cookies consent contentinfo "
    "disclaimer discussion footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted "
    "promotion recommended related reply responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar widget widgets complementary".split()
)
#: Share of a page's characters beyond which its neighbour counts as a copy of it.
COPY = 0.9
#: Bits of an alignment table that is kept whole (32 MB); larger ones are halved.
TABLE_BITS = 1 << 28
#: Pages of a range, and sampled keys for each: the driver sees that many keys, one in 2,000.
RANGE_ROWS, SAMPLED = 8_000, 4
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Za-z][a-z]*")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
#: Elements that end when another of their kind begins in the same parent.
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


#: What a name says of a part: goes, goes unless it holds most of the text, goes if the neighbour shares half of it.
COMMENT, NAMED, ASKED = 1, 2, 3


class Page(NamedTuple):
    """A page's blocks outside dropped elements, in order: text, how surely main text (2: yes, 1: in a marked element of main text, 0: no), and its marked parts by number; what each part's name says."""

    lines: list[tuple[str, int, tuple[int, ...]]]
    parts: list[int]


def marks(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, int]:
    """Whether an element is a part that is not main text, whether it is one of main text, and what its names say (0: nothing)."""
    drop, main, said = tag in PARTS, tag in MAIN, 0
    if attributes and ("=" in attributes or "hidden" in attributes):
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = next((v for v in values if v), ""), name.lower()
            if name == "hidden":
                drop = drop or tag not in ("html", "body")
            elif name == "itemprop":
                main = main or "articlebody" in value.lower()
            elif name == "role" and value.lower() in ("main", "article"):
                main = True
            elif tag not in ("html", "body") and (tag in BLOCKS or not inside):
                names = value.lower().split()
                if not COMMENTS.isdisjoint(names):
                    said = COMMENT
                elif not MARKS.isdisjoint(names):
                    said = said or NAMED
                elif not said and any(w.lower() in MARKS for w in WORD.findall(value)):
                    said = ASKED
    return drop, main, min(said, NAMED) if main else said


def lines_of(page: str) -> Page:
    out: list[tuple[str, int, tuple[int, ...]]] = []
    parts: list[int] = []
    pieces: list[str] = []
    stack: list[tuple[str, bool, int, tuple[int, ...]]] = [("", False, 0, ())]  # tag, dropped, main text, marked parts

    def push(tag: str, drop: bool, main: int, said: int) -> None:
        _, above, inside, own = stack[-1]
        if said:
            parts.append(said)
            own = (*own, len(parts) - 1)
        stack.append((tag, above or drop, main or inside, own))

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text and not stack[-1][1]:
                out.append((text, *stack[-1][2:]))
            pieces.clear()

    at, end = 0, len(page)
    while at < end:
        found = TAG.search(page, at)
        if not found:
            pieces.append(page[at:])
            break
        if found.start() > at:
            pieces.append(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag in BLOCKS or any(tag == x[0] for x in stack):
                flush()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            continue
        if tag in RAW_END:
            if not found[3].endswith("/"):
                closing = RAW_END[tag].search(page, at)
                at = closing.end() if closing else end
            pieces.append(" ")
            continue
        inside = stack[-1][2] > 0
        drop, main, said = marks(tag, found[3], inside)
        if tag not in BLOCKS:
            if tag == "br":
                pieces.append(" ")
            elif (drop or said) and tag not in VOID and tag not in ("a", "b", "i", "em", "strong"):
                flush()
                push(tag, drop, 0, said)
            continue
        flush()
        if stack[-1][0] == "p" and len(stack) > 1:
            stack.pop()
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SIBLINGS[tag]:
                    break
                if stack[i][0] == tag or {stack[i][0], tag} in ({"dt", "dd"}, {"td", "th"}):
                    del stack[i:]
                    break
        if tag in VOID:
            continue
        if main or tag == "header" and inside:
            drop = False
        if main and not inside:
            push(tag, drop, 1 if said in (COMMENT, NAMED) else 2, 0)
        else:
            push(tag, drop, 0, said)
    flush()
    return Page(out, parts)


def table_rows(own: list[str], other: list[str]) -> Iterator[int]:
    """Bit vectors of the LCS table's rows: bit j of row i is 0 where own[:i] and other[:j + 1] have one more line in common than own[:i] and other[:j]."""
    places: dict[str, int] = defaultdict(int)
    for j, line in enumerate(other):
        places[line] |= 1 << j
    full = v = (1 << len(other)) - 1
    yield v
    for line in own:
        u = v & places.get(line, 0)
        v = (v + u | v - u) & full
        yield v


def lengths(own: list[str], other: list[str]) -> np.ndarray:
    """The lengths of longest common subsequences of ``own`` with ``other[:j]``, for each j."""
    last = deque(table_rows(own, other), maxlen=1)[0]
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(other) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(other)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def aligned(own: list[str], other: list[str], most: int) -> list[int]:
    """The places in ``own`` of one longest common subsequence, with tables of at most ``most`` bits (Hirschberg's halves beyond)."""
    if not own or not other:
        return []
    if len(own) * len(other) > most and len(own) > 1:
        half = len(own) // 2
        cut = int(np.argmax(lengths(own[:half], other) + lengths(own[half:][::-1], other[::-1])[::-1]))
        return aligned(own[:half], other[:cut], most) + [half + i for i in aligned(own[half:], other[cut:], most)]
    rows, i, j, out = list(table_rows(own, other)), len(own), len(other), []
    while i and j:
        bit = 1 << (j - 1)
        if rows[i] & bit:
            j -= 1
        else:
            i -= 1
            if not i or rows[i] & bit:  # the line before had no such step: this one matches
                out.append(i)
                j -= 1
    return out[::-1]


def shared(own: list[str], other: list[str], most: int = TABLE_BITS) -> set[int]:
    """The places in ``own`` of one longest common subsequence of lines with ``other``, by bit vectors.

    The time is a sixty-fourth of the product of the two numbers of lines that both pages have, however often a line repeats.
    """
    mine, theirs = set(own), set(other)
    at = [i for i, line in enumerate(own) if line in theirs]
    return {at[i] for i in aligned([own[i] for i in at], [line for line in other if line in mine], most)}


def main_text(own: Page, other: Page | None) -> str:
    """The lines that stay, joined by empty lines. ``other``: the neighbour, None for a page without one."""
    best = max((m for _, m, _ in own.lines), default=0)
    lines = [(t, p) for t, m, p in own.lines if m == best]
    common = shared([t for t, _ in lines], [t for t, _, _ in other.lines]) if other else set()
    total = sum(len(t) for t, _ in lines)
    copy = sum(len(t) for i, (t, _) in enumerate(lines) if i in common) >= COPY * total
    size, alike, n = ([0] * len(own.parts) for _ in range(3))
    for i, (text, marked) in enumerate(lines):
        for k in marked:
            size[k] += len(text)
            n[k] += 1
            alike[k] += i in common
    asked = lambda k: n[k] and 2 * alike[k] >= n[k] and not (best and copy)
    gone = {k for k, said in enumerate(own.parts) if said == COMMENT or 2 * size[k] <= total and (said == NAMED or asked(k))}
    left = [(i, t) for i, (t, marked) in enumerate(lines) if gone.isdisjoint(marked)]
    copies = sum(len(t) for i, t in left if i in common) >= COPY * sum(len(t) for _, t in left)
    return "\n\n".join(t for i, t in left if best or copies or i not in common)


KEY = ["__host", "__path", "__order", "__page"]


def keyed(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url and html with the key by which pages are neighbours: host, path, whole url and id."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "[?#].*$", "")
    page = F.col(id_col).cast("long")
    return df.select(
        page.alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        F.lower(F.substring_index(bare, "/", 1)).alias("__host"), bare.alias("__path"), url.alias("__order"), F.coalesce(page, F.lit(-(1 << 63))).alias("__page"),
    )


def borders(keys: DataFrame, n: int, parts: int) -> list[tuple]:
    """At most ``parts`` - 1 keys that part the rows about evenly, from about ``parts`` * SAMPLED keys taken by hash."""
    every = max(1, n // (parts * SAMPLED))
    found = sorted(map(tuple, keys.where(F.pmod(F.xxhash64(*KEY), F.lit(every)) == 0).distinct().collect()))
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def ranges_of(limits: list[tuple], extra: dict[tuple, list[int]]) -> Callable[..., Column]:
    """The range that a key belongs to, then the ranges that read it as a neighbour."""

    @F.pandas_udf("array<int>")
    def places(host: pd.Series, path: pd.Series, order: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([[bisect_right(limits, k), *extra.get(k, ())] for k in zip(host, path, order, page.tolist(), strict=True)])

    return places


def extract(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", partitions: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row.

    A page's neighbour is the one before it in its host's order of path, url and id (after it, for a host's first
    page), wherever the ranges of pages that tasks read begin and end: a range also reads the pages next to it. Pages
    with equal keys are in the order of a hash of their html. A null or empty page has an empty text. A null url stays
    null and is sorted as an empty one, a null id first. Broken markup is read as far as it goes. Repeated rows each
    give a row; an empty table gives an empty one. Other columns are not read.
    """
    spark = prepare(df.sparkSession)
    rows = keyed(df, id_col, url_col, html_col)
    keys = rows.select(*KEY)
    n = keys.count()
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    limits = borders(keys, n, parts)
    ends = keys.select(F.struct(*KEY).alias("key"), ranges_of(limits, {})(*KEY)[0].alias("part")).groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    ends = sorted((r["part"], tuple(r["first"]), tuple(r["last"])) for r in ends.collect())  # two keys a range
    extra: dict[tuple, list[int]] = defaultdict(list)
    for (p, _, last), (q, first, _) in zip(ends, ends[1:], strict=False):
        if last[0] == first[0]:
            extra[last].append(q)
            extra[first].append(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[tuple, Page] | None = None  # (range, host) and lines of the page before
        waiting: tuple | None = None
        for batch in by_bytes(batches):
            done: list[tuple] = []
            for page_id, address, page, host, part, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines, place = lines_of(page or ""), (part, host)
                if waiting:
                    done.append((*waiting[:2], main_text(waiting[2], lines if waiting[3] == place else None)))
                    waiting = None
                if before and before[0] == place:
                    if own:
                        done.append((page_id, address, main_text(lines, before[1])))
                elif own:
                    waiting = (page_id, address, lines, place)
                before = (place, lines)
            if done:
                yield batch_of(done)
        if waiting:
            yield batch_of([(*waiting[:2], main_text(waiting[2], None))])

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        ids, urls, texts = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=SCHEMA)

    read = rows.select("*", F.posexplode(ranges_of(limits, dict(extra))(*KEY)).alias("__at", "__part"))
    near = read.repartition(parts, "__part").sortWithinPartitions("__part", *KEY, F.xxhash64("html"))
    return near.select("page_id", "url", "html", "__host", "__part", F.col("__at") == 0).mapInArrow(run, "page_id long, url string, text string, n_chars long")

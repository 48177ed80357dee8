"""Token counts from pre-token frequencies.

In a worker, each distinct pre-token is encoded once; its number of pieces is joined to the documents'
pre-token frequencies and summed, so ids of texts are never made and nothing is shuffled: at any size the operator
is one scan. The dictionary of a worker is bounded by ``MOST_KNOWN`` entries; beyond it, it starts anew, which costs
a second encoding of some pre-tokens and changes no count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrachron.llm.common import by_bytes, prepare
from terrachron.llm.pretokens import byte_level, ids_of

MOST_KNOWN = 400_000
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


@lru_cache(maxsize=2)
def known_pieces(path: str) -> dict[str, int]:
    """A worker's pre-tokens and their pieces; they outlive its tasks."""
    return {}


def count_batch(texts: list[str | None], path: str, known: dict[str, int]) -> tuple[list[int], list[int]]:
    """UTF-8 bytes and tokens of each text; ``known`` has the pieces of the pre-tokens met so far."""
    if len(known) > MOST_KNOWN:
        known.clear()
    frequencies, extra = [], []
    for text in texts:
        pre, special = byte_level(path, text or "")
        frequencies.append(Counter(pre))
        extra.append(special)
    if new := list({p for f in frequencies for p in f if p not in known}):
        known.update((p, len(ids_of(path, p))) for p in new)
    sizes = [len((t or "").encode()) for t in texts]
    return sizes, [x + sum(n * known[p] for p, n in f.items()) for f, x in zip(frequencies, extra, strict=True)]


def token_counts(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows each give a row; an empty
    table gives an empty one. Other columns of ``df`` are not read, whatever their names.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_pieces(tokenizer_path)
        for batch in by_bytes(batches):
            sizes, counts = count_batch(batch.column(1).to_pylist(), tokenizer_path, known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], schema=SCHEMA)

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

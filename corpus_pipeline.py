"""The corpus pipeline: toxicity, language, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a DataFrame; all but
the last return the columns of documents. The first two and the fourth drop the rows they reject, the third keeps
the row with the smallest id of each group, the last returns the packed pieces.

For every stage: null texts count as empty ones, rows with a null id are judged like others, repeated rows are judged
alike, an empty table gives an empty one, and further columns of ``docs``, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrachron.llm import near_copies, op2_simhash, op3_langid, op6_toxicity, op9_decontamination, op10_packing
from terrachron.llm.common import drop_stored, stored
from terrachron.llm.queries import table, tokenizer


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from ``labels``. Without labels of both kinds the score is the share of toxic ones, and without any nothing goes."""
    return op6_toxicity.keep_clean(docs, op6_toxicity.train(docs, table(spark, sf_dir, "labels")))


#: Languages that stay (None: all that are learned), and the least score.
LANGUAGES, LEAST_SCORE = None, op3_langid.LEAST_SCORE


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose language is one of ``LANGUAGES`` with a score of ``LEAST_SCORE`` or more; empty texts and texts without a letter go."""
    return op3_langid.keep_identified(docs, op3_langid.train(docs), languages=LANGUAGES, least=LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id: groups are linked by 0.8 of similarity or more on five-word shingles. Rows without an id stay."""
    return op2_simhash.keep_one(docs, groups=near_copies.near_copies)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in which ten words in a row of an item of ``benchmark`` occur, or all of a shorter one."""
    return op9_decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of ``op10_packing.pack``."""
    return op10_packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: Fitted models and a tokenizer: SQL can't express them; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            drop_stored(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""One query for each training-data operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrachron.llm import op1_tokens, op2_simhash, op3_langid, op4_lm, op5_html, op6_toxicity, op7_sharding, op8_gif, op9_decontamination, op10_packing, op11_spelling, op12_collocations, op13_substrings
from terrachron.llm.common import prepare


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_langid.language_id(table(spark, sf_dir, "documents"))


def op4_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_lm.score(table(spark, sf_dir, "documents"))


def op5_html_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_html.extract(table(spark, sf_dir, "pages"))


def op6_toxicity_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return op6_toxicity.score(documents, op6_toxicity.train(documents, table(spark, sf_dir, "labels")))


def op7_sharding_hypergeometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op8_gif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_gif.store_texts(table(spark, sf_dir, "documents"))


def op9_decontamination_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_spelling_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_collocation_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_collocations.collocations(table(spark, sf_dir, "documents"))


def op13_substring_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_substrings.removals(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_counts, op2_simhash_vptree, op3_language_id, op4_lm_trie, op5_html_differencing, op6_toxicity_nb, op7_sharding_hypergeometric, op8_gif_columns, op9_decontamination_index, op10_packing_nnls, op11_spelling_partenum, op12_collocation_tiling, op13_substring_anchors]
    return {f.__name__: f for f in found}


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s : s + 9], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw))
), m AS (SELECT DISTINCT rid, s, n, item FROM dw JOIN bw USING (win, n)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, s, n FROM m)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""

OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, m, array_to_string(w[s : s + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM w, range(1, 5) AS sizes(m) WHERE len(w) >= m)
), f AS (SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY lang, m, phrase),
totals AS (SELECT lang, sum(n) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND n >= 30),
cuts AS (
  SELECT x.lang, x.phrase, a, k, l.n AS l, r.n AS r, CAST(2000000 AS HUGEINT) * a // (l.n + r.n) AS score
  FROM (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : m], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM c)) AS x
    JOIN f AS l ON l.lang = x.lang AND l.phrase = x.head JOIN f AS r ON r.lang = x.lang AND r.phrase = x.tail
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, array_to_string(w[s : s + k - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, k, unnest(range(1, m - k + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS k FROM c)) GROUP BY ALL
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score
  FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, rank, phrase, a, l, r, CAST(totals.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(doc_id, 9223372036854775807) AS known, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), g AS (SELECT rid, known, s, array_to_string(w[s : s + 19], ' ') AS win FROM (SELECT rid, known, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
late AS (SELECT rid, s FROM g QUALIFY rank() OVER (PARTITION BY win ORDER BY known, s) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(s, s + 20)) AS p FROM late),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    """Left out where DuckDB has no tokenizer, seeded hash, checksum, hypergeometric draw, LZW or fit; tests/llm holds these against brute force."""
    return {"op9_decontamination_index": OP9_SQL, "op12_collocation_tiling": OP12_SQL, "op13_substring_anchors": OP13_SQL}

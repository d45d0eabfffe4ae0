"""Registered queries of the corpus operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trafficscore.llm import (bpe, decontam, lexical, licenses, pages, pii, quality, secrets, sharding, simhash, suffixes,
                              syncmers, variants)
from trafficscore.llm.common import read_table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that whole documents hold, with up to a fifth of their words edited."""
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-syncmer fingerprints of every whole text and of its edited text."""
    return syncmers.edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal counts, equal texts together."""
    return sharding.documents(read_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: fixed patterns and the randomness battery."""
    return secrets.report(read_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: checked patterns and boosted candidates."""
    return pii.report(read_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every whole text."""
    return bpe.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS),
                       public_tokenizers.PATTERN)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts without the 50-byte strings that a smaller doc_id's text has too."""
    return suffixes.report(read_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learnt from the labels that aren't held out."""
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, without its site's template."""
    return pages.main_texts(read_table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit SimHash fingerprints and the components of those at most two bits apart."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of every whole text."""
    return licenses.report(read_table(spark, sf_dir, "documents"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts with their near words, form and root."""
    return variants.variants(read_table(spark, sf_dir, "documents"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_decontam, op2_syncmers, op3_sharding, op4_secrets, op5_pii, op6_bpe, op7_suffixes, op8_quality, op9_pages,
    op10_simhash, op11_licenses, op12_variants, op13_lexical)}

SQL: dict[str, str] = {
    "op13_lexical": r"""
WITH d AS (
  SELECT row_number() OVER () AS d, doc_id,
         list_transform(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+'),
                        lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ts
  FROM documents),
i AS (
  SELECT row_number() OVER () AS i, item_id,
         list_transform(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+'),
                        lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ts
  FROM benchmark),
c AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_all FROM d),
m AS (SELECT d, doc_id, 100 - 75 + ((75 * len(ts) * n_docs) // n_all)::BIGINT AS m FROM d, c WHERE len(ts) > 0),
tf AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(ts) AS t FROM d) GROUP BY d, t),
it AS (SELECT i, item_id, t, count(*) AS times FROM (SELECT i, item_id, unnest(ts) AS t FROM i) GROUP BY i, item_id, t),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM tf, c GROUP BY t, n_docs),
s AS (SELECT i, item_id, d, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM it JOIN tf USING (t) JOIN w USING (t) JOIN m USING (d) GROUP BY i, item_id, d, doc_id),
r AS (SELECT item_id, doc_id, score,
             row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
}

"""The corpus pipeline: each stage calls one operator of ``trafficscore.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
``run`` applies them to ``documents``.

1. quality: documents that the classifier rejects go.
2. near duplicates: of each SimHash group the document of smallest doc_id stays.
3. decontamination: documents that hold a benchmark item go.
4. secrets: every secret span becomes ``[SECRET]``; no document goes.
5. encoding: token ids of what is left, with digests of the ids and of the
   bytes they decode to.

Documents without text are scored, fingerprinted (as empty) and encoded (no
ids) like others; documents without doc_id are no near duplicates of others.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trafficscore.llm import bpe, decontam, quality, secrets, simhash
from trafficscore.llm.common import read_table
from trafficscore.llm.queries import RANKS
from trafficscore.session import checkpoint_dir, ship_package


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents whose score reaches the threshold."""
    ship_package(spark)
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, with the shingle length and bit distance of its contract."""
    ship_package(spark)
    return simhash.keep_one(docs, shingle=simhash.SHINGLE_WORDS, max_bits=simhash.MAX_BITS)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that hold no benchmark item."""
    ship_package(spark)
    return decontam.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: secrets masked, n_chars brought up to date."""
    ship_package(spark)
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: digests of the token ids and of the decoded bytes."""
    ship_package(spark)
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one),
    ("benchmark decontamination", keep_clean),
    ("secret scans", redact),
    ("byte-level BPE encoding and decoding", encode),
]
#: The classifier, the fingerprints and the encoder can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the
    shared checkpoint folder and read again."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

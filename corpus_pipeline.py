"""A corpus pipeline: quality rules, near-duplicate removal, secret redaction, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.

Defined cases, by stage. Rules: a null or empty text has too few words and goes; repeated
rows are judged alike. Near-duplicates: of copies and near copies one row stays, that of
the smallest doc_id; rows without doc_id come after all others; texts without words are
linked with nothing. Secrets: a null text has none. Mixing: a text without words is not
taken, a null source comes last; a row that is taken again comes again. BPE: a null text
has no ids. Texts of any length are handled whole. An empty table passes through every
stage as an empty table. All columns of docs pass through all stages but the last, also
those that are named like a column that an operator adds.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.llm import byte_bpe, common, mixing, near_dedup, quality_rules, secret_scan

#: SQL can express neither sketches nor the mix's seeded choice; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id; a document without doc_id comes after all others."""
    return near_dedup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes words of a document, with the words that it then takes."""
    return mixing.materialize(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with the digests of the ids and of the bytes decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_documents(docs, path, keep=("lang", "source"), decoded=True).withColumn("ids_sha256", F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256))


STAGES = [("quality rules", rules), ("near-duplicates", dedup), ("secrets", secrets), ("mixing", mixture), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, "pipeline-" + name.replace(" ", "-"))
    return docs

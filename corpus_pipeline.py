"""The training-data pipeline over the documents table.

Stages, in order: language ID (rejected documents go), SimHash near-dedup (one
document of each group stays), suffix-array dedup (repeated passages go), secret
scans (secrets are replaced) and packing.  Every stage works on all its
predecessor kept and, but for the last, returns the columns of ``documents``; the
last returns the pieces that make up the packed sequences.

Rows of null or letterless text and rows without a doc_id are treated as each
stage's module says: the first rejects texts without a language; rows without
doc_id have no copies; of rows that share a doc_id or a text one stays.  An empty
table gives an empty one, ties go to the least doc_id, and extra columns of any
names are carried through all stages but the last.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inundate.llm import langid, packing, secrets, simhash, suffixes
from inundate.sources.store import shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.cut_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("repeat_dedup", repeat_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing_),
]

#: SQL cannot express trained models, suffix arrays or the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each result is written as Parquet and read again.

    The tables go to the folder named in ``spark.checkpoint.dir`` (in local mode, where
    that is unset, to a temporary one).
    """
    shared = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = os.path.join(shared, f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        out = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs

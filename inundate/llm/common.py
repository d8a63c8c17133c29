"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that part words, as in ``[^\x20\x09-\x0D]+``.
#: ``bytes.split()`` without arguments splits at exactly these.
SPACES = b" \t\n\r\x0b\x0c"

LETTER = re.compile(r"[^\W\d_]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of an input folder, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch between the engine and a Python worker.
BATCH_BYTES = 8 << 20


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches hold at most ``BATCH_BYTES``, so that a task's memory does not
    depend on how long ten thousand rows are.  A smaller setting stays."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return docs


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; all others are left behind."""
    return bounded(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def sample(docs: DataFrame, rows: int, *columns) -> list:
    """At most ``rows`` rows by order of a hash of doc_id, for fitting a model only.

    The choice depends on the ids alone, so it is the same for any partitioning.
    A cut on the hash, set from the number of rows, leaves about three times what
    is wanted, so tasks send little however many there are.
    """
    wanted = min(1.0, 3 * rows / max(docs.count(), 1))
    hashed = docs.withColumn("_h", F.xxhash64("doc_id"))
    if wanted < 1:
        hashed = hashed.where(F.shiftrightunsigned("_h", 16) < int(wanted * (1 << 48)))
    return hashed.select("_h", F.col("doc_id").alias("_id"), *columns).orderBy("_h", "_id").limit(rows).collect()


def piece(text, width: int = 4000):
    """``width`` characters of a text from a place that a hash picks (model fitting only)."""
    room = F.greatest(F.length(text) - F.lit(width), F.lit(0)) + F.lit(1)
    return F.substring(text, F.pmod(F.xxhash64(text), room).cast("int") + F.lit(1), F.lit(width))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def slices(it, chars: int = 1 << 22, column: str = "text"):
    """Record batches cut into parts of about ``chars`` bytes of text, so memory stays
    bounded however long the texts are; a single longer text makes a part of its own."""
    for b in it:
        col = b.column(column)
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > chars:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield b.slice(start, len(sizes) - start)

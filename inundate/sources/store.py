"""Durable intermediate tables."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's ``spark.checkpoint.dir``, which all executors share.

    A temporary folder stands in for it in local mode (tests); on a cluster, where
    executors would each write to their own disk, it must be set.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir")
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", conf.get("spark.master") or ""):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="inundate-")


def checkpointed(df: DataFrame, sized: bool = True) -> DataFrame:
    """The table, written to the checkpoint folder all executors share, without its lineage.

    With ``sized=False`` its size is unknown to the planner, as is that of all tables
    made from it: an estimate by the size of compressed files may be a thirtieth of
    what a table takes in memory, and so send it through the driver to all executors.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return _size_bounded(df.checkpoint(eager=True), sized)


def _size_bounded(df: DataFrame, sized: bool = True) -> DataFrame:
    """The same table, its estimated size unknown where no table is as large, or without ``sized``.

    A checkpoint keeps the estimate of its plan, and a join's is the product of its
    sides': over the rounds of a loop the number's length doubles or trebles each time,
    until the driver spends its memory and time on that number alone.
    """
    spark, plan = df.sparkSession, df._jdf.queryExecution().analyzed()
    if sized and plan.stats().sizeInBytes() < 1 << 63:
        return df
    jvm = spark.sparkContext._jvm
    unknown, constraints = jvm.scala.Option.empty(), jvm.scala.Option.apply(plan.constraints())
    plan = jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, unknown, constraints
    )
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)

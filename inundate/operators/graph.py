"""Iterative graph operators: pointer doubling, accumulation and connected components.

Every round is checkpointed, so lineage stays one round long and a lost executor
costs one round.  The number of rounds is logarithmic in path length.  A graph of at
most ``ALONE`` rows (its size is checked) goes through all its rounds in one task,
with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import checkpointed


#: Rows of a graph up to which one task solves it; its arrays take some 100 bytes a row.
ALONE = 4_000_000


def small(df: DataFrame) -> bool:
    """Whether a durable table has at most ``ALONE`` rows."""
    return df.count() <= ALONE


def alone(df: DataFrame, solve: Callable[..., tuple], schema: str) -> DataFrame:
    """``solve`` over the columns of a small table as arrays, in one task."""
    names, wanted = df.columns, [x.split()[0] for x in schema.split(", ")]

    def run(it):
        parts = [pa.Table.from_batches([b]) for b in it]
        if parts:
            rows = pa.concat_tables(parts).combine_chunks()
            got = solve(*(rows[n].to_numpy() for n in names))
            if len(got[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], wanted)

    return df.coalesce(1).mapInArrow(run, schema)


def _placed(cell: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells in order of their numbers, and each one's next cell's place (its own where that is not in the table)."""
    order = np.argsort(cell, kind="stable")
    cell, at = cell[order], at[order]
    place = np.minimum(np.searchsorted(cell, at), len(cell) - 1)
    return order, np.where(cell[place] == at, place, np.arange(len(cell)))


def _terminals(cell, at):
    order, to = _placed(cell, at)
    lost = np.sort(cell)[to] != at[order]  # paths that leave the table end where they point to
    last = np.where(lost, at[order], cell[order])
    while not np.array_equal(to, further := to[to]):
        to = further
    return cell[order], last[to]


def _marked(cell, at, on):
    order, to = _placed(cell, at)
    on = on[order].astype(bool)
    while True:
        on[to[on]] = True
        if np.array_equal(to, further := to[to]):
            return (cell[order][on],)
        to = further


def _gathered(join):
    def solve(cell, at, acc):
        order, to = _placed(cell, at)
        acc, to = acc[order].copy(), np.where(to == np.arange(len(to)), -1, to)
        while (on := to >= 0).any():
            sent = acc.copy()
            join.at(acc, to[on], sent[on])
            to = np.where(on, to[to], -1)
        return cell[order], acc

    return solve


def _least_reached(a, b):
    nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    least = np.arange(len(nodes))
    while True:
        before = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while not np.array_equal(least, up := least[least]):
            least = up
        if np.array_equal(least, before):
            moved = least != np.arange(len(nodes))
            return nodes[moved], nodes[least[moved]]


def terminals(pointers: DataFrame, cell: str = "cell", down: str = "down") -> DataFrame:
    """(cell, terminal): where each cell's path ends.  A terminal points to itself."""
    now = checkpointed(pointers.select(F.col(cell).cast("bigint").alias("cell"), F.col(down).cast("bigint").alias("at")))
    if small(now):
        return alone(now, _terminals, "cell long, terminal long")
    while True:
        hop = now.select(F.col("cell").alias("at"), F.col("at").alias("beyond"))
        new = checkpointed(now.join(hop, "at", "left").select("cell", F.coalesce("beyond", "at").alias("next"), (F.coalesce("beyond", "at") != F.col("at")).alias("moved")))
        now = new.select("cell", F.col("next").alias("at"))
        if not new.where("moved").limit(1).count():
            return now.withColumnRenamed("at", "terminal")


def paths_from(starts: DataFrame, pointers: DataFrame, cell: str = "cell", down: str = "down") -> DataFrame:
    """(cell): every cell on the paths of the starting cells, them and the terminals included.

    Marked cells send the mark 1, 2, 4, ... steps on, so a path of any length takes a
    logarithmic number of rounds.
    """
    marked = checkpointed(starts.select(F.col(cell).alias("cell")).distinct())
    jump = checkpointed(pointers.select(F.col(cell).cast("bigint").alias("cell"), F.col(down).cast("bigint").alias("at")))
    if small(jump):
        return alone(jump.join(marked.withColumn("on", F.lit(1)), "cell", "left").select("cell", "at", F.coalesce("on", F.lit(0)).alias("on")), _marked, "cell long")
    while True:
        marked = checkpointed(marked.unionByName(marked.join(jump, "cell").select(F.col("at").alias("cell"))).distinct())
        hop = jump.select(F.col("cell").alias("at"), F.col("at").alias("beyond"))
        new = checkpointed(jump.join(hop, "at").select("cell", F.col("beyond").alias("at"), (F.col("beyond") != F.col("at")).alias("moved")))
        jump = new.select("cell", "at")
        if not new.where("moved").limit(1).count():
            return marked


def accumulate(pointers: DataFrame, cell: str = "cell", down: str = "down", weight: str | None = None, least: bool = False) -> DataFrame:
    """(cell, acc): the cells (or their weights) whose path passes a cell, itself included; with ``least`` their least weight."""
    start = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    now = checkpointed(pointers.select(F.col(cell).cast("bigint").alias("cell"), F.col(down).cast("bigint").alias("at"), start.alias("acc")))
    if small(now):
        return alone(now, _gathered(np.minimum if least else np.add), f"cell long, acc {now.schema['acc'].dataType.simpleString()}")
    now = now.withColumn("at", F.when(F.col("at") != F.col("cell"), F.col("at")))
    while now.where("at is not null").limit(1).count():
        sent = now.where("at is not null").groupBy(F.col("at").alias("cell")).agg((F.min("acc") if least else F.sum("acc")).alias("more"))
        hop = now.select(F.col("cell").alias("at"), F.col("at").alias("beyond"))
        moved = now.join(hop, "at", "left").select("cell", F.col("beyond").alias("at"), "acc")
        both = F.least("acc", "more") if least else F.col("acc") + F.coalesce("more", F.lit(0))
        now = checkpointed(moved.join(sent, "cell", "left").select("cell", "at", both.alias("acc")))
    return now.select("cell", "acc")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def smallest_reachable(links: DataFrame, together: bool = False) -> DataFrame:
    """From links (a, b): (a, b), b the least node that a reaches, for every a that isn't it.

    Alternating large and small stars; with ``together`` a small graph in one task.  An
    empty table gives an empty table.
    """
    now = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if together and small(now):
        return alone(now, _least_reached, "a long, b long")
    before = None
    while (state := _state(now)) != before and state[0]:
        before, now = state, checkpointed(_small_star(_large_star(now)))
    return now

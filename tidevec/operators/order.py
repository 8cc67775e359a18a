"""Positions in the global order (ts, uid) without sorting everything in one task.

Rows are range-partitioned and sorted within their partitions, which are then fixed in
the shared checkpoint folder: a partition's rows stay the same however often a task is
run. Counts of the partitions give where each starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidevec.session import shared_dir

_ROW = 33  # bits that monotonically_increasing_id() has for the row within its partition


def positions(df: DataFrame, name: str = "pos", descending: bool = False) -> DataFrame:
    """df with each row's position from 0, by (ts, uid); descending gives last-in-first-out order.
    Rows with equal ts and uid are numbered in an arbitrary order among themselves. A null ts comes first."""
    spark = df.sparkSession
    shared_dir(spark)
    order = [F.col("ts").desc(), F.col("uid").desc()] if descending else [F.col("ts"), F.col("uid")]
    fixed = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint(eager=True)
    rows = fixed.withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", _ROW)
    counts = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    starts, at = [], 0
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    first = F.broadcast(spark.createDataFrame(starts, "_part bigint, _start bigint"))
    numbered = rows.join(first, part == F.col("_part"))
    return numbered.withColumn(name, F.col("_start") + F.col("_m").bitwiseAND((1 << _ROW) - 1)).drop("_m", "_part", "_start")

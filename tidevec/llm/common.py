"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from tidevec.session import shared_dir

#: Rows of a few numbers that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Rows of a few numbers that a task has before there are more tasks.
TASK_ROWS = 20_000


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``cut`` for what is read several times, a few columns at once: a Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/tidevec-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has no more than ``most`` rows. It is read for that: cut it before."""
    return F.broadcast(df) if df.count() <= most else df


def fewer(df: DataFrame, rows: int) -> DataFrame:
    """df in as few partitions as so many rows need: small tables that are shuffled again and again cost files and tasks
    by the number of partitions, not by their size."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined with a table of distinct keys that says (column ``count``) how many of the rows each key has.

    A table of ``most`` rows is broadcast. Of a larger one, the keys of over total / most rows, which can't be more
    than ``most``, are broadcast, so no key meets in one task; the others are shuffled. table is read
    several times: cut it before. how: 'inner' or 'left_semi'.
    """
    if table.count() <= most:
        return rows.join(F.broadcast(table.drop(count)), on, how)
    often = F.col(count) > total // most
    hot = table.where(often).drop(count)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(table.where(~often).drop(count), on, how)
    return rows.join(F.broadcast(hot), on, how).unionByName(cold)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the given names; extra columns cannot clash."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character keeps its code point."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bounded_sample(df: DataFrame, text_col: str, rows: int) -> DataFrame:
    """About ``rows`` rows at most, one a distinct text: those whose text hash is below a share of the hash range.

    The share is rows / count, so the size is bounded whatever the input; small inputs are taken whole.
    The same texts give the same sample in any order or partitioning.
    """
    n = df.count()
    hashed = df.withColumn("_h", F.xxhash64(text_col))
    if n > rows:
        below = int(rows / n * 2**64) - 2**63
        hashed = hashed.where(F.col("_h") < F.lit(below))
    first = [F.min(F.struct(*df.columns)).alias("_r")]
    return hashed.groupBy("_h").agg(*first).select("_r.*")

"""Element-wise aggregates of windows. ``rows`` are windowed records: wid, slot, uid, ts, vec."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KINDS = ("avg", "sum", "first", "count")


def elements(rows: DataFrame, kind: str = "avg", by: str = "wid") -> DataFrame:
    """by, pos and value: the element-wise average or sum in double, a row for each element."""
    if kind not in ("avg", "sum"):
        raise ValueError(f"element-wise {kind}?")
    flat = rows.select(by, F.posexplode("vec").alias("pos", "x"))
    fold = F.avg if kind == "avg" else F.sum
    return flat.groupBy(by, F.col("pos").cast("bigint").alias("pos")).agg(fold(F.col("x").cast("double")).alias("value"))


def aggregate(rows: DataFrame, kind: str = "avg", by: str = "wid") -> DataFrame:
    """A record for each window: by, uid, ts, vec. uid and ts are those of the window's first row; vec is the
    element-wise average or sum, or the first row's vector. ``count`` gives by and n."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
    if by not in rows.columns:
        raise ValueError("an aggregate needs windows")
    if kind == "count":
        return rows.groupBy(by).agg(F.count("*").alias("n"))
    first = F.min_by(F.struct("uid", "ts", "vec"), F.struct("slot", "uid")).alias("f")
    firsts = rows.groupBy(by).agg(first)
    if kind == "first":
        return firsts.select(by, "f.uid", "f.ts", "f.vec")
    whole = elements(rows, kind, by).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    return firsts.join(whole, by).select(by, "f.uid", "f.ts", F.transform("v", lambda x: x["value"]).alias("vec"))


def running_mean(rows: DataFrame, column: str, every: int, by: str = "pos") -> DataFrame:
    """part, mean and n: the mean of a column over each ``every`` values of the positions in ``by``."""
    return rows.groupBy(F.floor(F.col(by) / every).cast("bigint").alias("part")).agg(F.avg(column).alias("mean"), F.count(column).alias("n"))


def duplicates(rows: DataFrame, by: str = "uid") -> DataFrame:
    """How often each id that occurs more than once does."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).where("n > 1")

"""Count windows over records, in the order of (ts, uid).

A window is a set of rows with one ``wid``; ``slot`` is a row's place in it.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, functions as F

from tidevec.operators.order import positions


def tumbling(df: DataFrame, size: int, slide: int | None = None, keep_partial: bool = False) -> DataFrame:
    """Windows of ``size`` rows, one after another. A last window that isn't full is left out, as it is never
    emitted on a stream, unless keep_partial is set. A slide has no meaning here and is ignored with a warning."""
    _positive(size)
    if slide not in (None, size):
        warnings.warn("a tumbling window has no slide; it is ignored", stacklevel=2)
    rows = positions(df, "_p")
    rows = rows.withColumn("wid", F.floor(F.col("_p") / size).cast("bigint")).withColumn("slot", F.pmod("_p", F.lit(size)))
    if not keep_partial:
        full = df.count() // size
        rows = rows.where(F.col("wid") < full)
    return rows.drop("_p")


def sliding(df: DataFrame, size: int, slide: int = 1) -> DataFrame:
    """Windows of the last ``size`` rows, one at every ``slide``-th row once the first is full; every row is
    copied into the at most ceil(size / slide) windows that hold it."""
    _positive(size)
    _positive(slide)
    n = df.count()
    last = (n - size) // slide  # the last window's number
    rows = positions(df, "_p")
    first = F.greatest(F.lit(0), F.ceil((F.col("_p") - size + 1) / slide)).cast("bigint")
    final = F.least(F.lit(last), F.floor(F.col("_p") / slide)).cast("bigint")
    rows = rows.withColumn("_f", first).withColumn("_l", final).where("_f <= _l")
    rows = rows.withColumn("wid", F.explode(F.sequence("_f", "_l")))
    return rows.withColumn("slot", F.col("_p") - F.col("wid") * slide).drop("_p", "_f", "_l")


def _positive(n: int) -> None:
    if n < 1:
        raise ValueError("sizes and slides are positive")

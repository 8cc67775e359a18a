"""Counters and timings of runs, and reports of them as tab-separated files."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


@dataclass
class Metrics:
    """Counters by name; times in milliseconds."""

    values: dict[str, float] = field(default_factory=dict)

    def add(self, name: str, amount: float = 1) -> None:
        self.values[name] = self.values.get(name, 0) + amount

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.add(f"{name}_ms", (time.perf_counter() - began) * 1000)

    def dump_tsv(self, path: str) -> None:
        with open(path, "w") as f:
            f.write("metric\tvalue\n" + "".join(f"{k}\t{v:g}\n" for k, v in self.values.items()))


def observed(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """df, and an observation of how many rows pass, which costs no extra pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def append_report(spark: SparkSession, path: str, **row) -> None:
    """One more line of a report in a folder of tab-separated files."""
    spark.createDataFrame([row]).coalesce(1).write.mode("append").option("sep", "\t").option("header", True).csv(path)


def quality(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """recall, precision and f1 of found pairs against the true ones; null where there is nothing to divide by."""
    f, t = found.select(*keys).distinct().withColumn("_f", F.lit(1)), truth.select(*keys).distinct().withColumn("_t", F.lit(1))
    n = f.join(t, keys, "full").agg(F.sum(F.when(F.col("_f").isNotNull() & F.col("_t").isNotNull(), 1).otherwise(0)).alias("both"), F.count("_f").alias("f"), F.count("_t").alias("t"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return n.select(ratio(F.col("both"), F.col("t")).alias("recall"), ratio(F.col("both"), F.col("f")).alias("precision"), ratio(2 * F.col("both"), F.col("f") + F.col("t")).alias("f1"))

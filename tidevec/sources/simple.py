"""Sources in memory and in ordinary formats, and how rows are dealt to consumers."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidevec.schema import record_schema, records

SCHEMA = record_schema("float64")


class MemorySource:
    """Rows added one by one, as a DataFrame when asked for. A limit holds back a producer that adds too many."""

    def __init__(self, spark: SparkSession, name: str = "memory", limit: int = 1 << 20):
        self.spark, self.name, self.limit, self._rows = spark, name, limit, []

    def add(self, uid: int, ts: int | None, vec: list[float]) -> None:
        if len(self._rows) >= self.limit:
            raise BufferError(f"{self.name} holds {self.limit} rows already")
        self._rows.append((int(uid), int(time.time() * 1000) if ts is None else int(ts), [float(x) for x in vec]))

    def drain(self) -> list[tuple]:
        rows, self._rows = self._rows, []
        return rows

    def dataframe(self) -> DataFrame:
        return self.spark.createDataFrame(self._rows, SCHEMA)


def read_csv(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """id, dim1 .. dimN with a header line, as records whose timestamp is the id."""
    schema = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(f"dim{i + 1}", T.DoubleType()) for i in range(dim))])
    rows = spark.read.csv(path, header=True, schema=schema)
    return records(rows.select(F.col("id").alias("uid"), F.col("id").alias("ts"), F.array(*[f"dim{i + 1}" for i in range(dim)]).alias("vec")))


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1000) -> DataFrame:
    """A stream of the rows in parquet files that arrive under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def fan_out(df: DataFrame, policy: str = "broadcast", slots: int = 4) -> list[DataFrame]:
    """df for each of some consumers: all rows for every one ('broadcast'), or those with uid % slots equal to
    the consumer's number ('hash'). Both are plans over the same scan."""
    if policy == "broadcast":
        return [df] * slots
    if policy == "hash":
        return [df.where(F.pmod("uid", F.lit(slots)) == i) for i in range(slots)]
    raise ValueError(f"unknown policy {policy!r}")

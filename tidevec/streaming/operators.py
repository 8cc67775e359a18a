"""Operators on streams: count windows, the similarity join, top-k, and runs that end by themselves.

Each gives on a finished stream what its batch form gives on the same rows.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidevec.functions import vectors
from tidevec.operators import topk as search
from tidevec.schema import event_time
from tidevec.session import shared_dir


#: The state store that can hold several states of a key; Spark's default one can't.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of windows given out at once.
OUT_ROWS = 10_000
#: Records of an index that a stream's probes broadcast at most.
PROBE_ROWS = 100_000
#: Watermarks start at zero, so event times are moved on by so many milliseconds: timestamps may be zero or less.
EPOCH = 1 << 40


def _numbers(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers, and which of them are null."""
    null = column.isna().to_numpy()
    return (column.where(~null, 0) if null.any() else column).to_numpy(np.int64), null


class _CountWindow(StatefulProcessor):
    """Numbers a key's rows in order and keeps those of the windows that are not full yet. The rows of a batch are held as
    plain numbers, and windows are given out some thousand rows at a time."""

    def __init__(self, size: int, slide: int, kind: str):
        self.size, self.slide, self.kind = size, slide, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n bigint")
        self.held = handle.getListState("held", "uid bigint, ts bigint, vec array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        before = self.seen.get()[0] if self.seen.exists() else 0
        held = pd.DataFrame([tuple(x) for x in self.held.get()], columns=["uid", "ts", "vec"], dtype=object)
        parts = [self._plain(frame) for frame in itertools.chain([held], rows)]
        h = len(held)
        (uid, no_uid), (ts, no_ts) = ([np.concatenate(c) for c in zip(*(p[k] for p in parts))] for k in (0, 1))
        dim, values = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
        del parts
        begin = np.cumsum(dim) - dim
        order = np.r_[np.arange(h), h + np.lexsort((uid[h:], no_uid[h:], ts[h:], no_ts[h:]))]  # nulls come last
        n = before + len(order) - h

        def part(at: np.ndarray) -> dict[str, list | pd.Series]:
            at = order[at]
            whole = lambda x, null: pd.Series(x[at]).astype("Int64").mask(null[at]) if null[at].any() else pd.Series(x[at])
            return {"uid": whole(uid, no_uid), "ts": whole(ts, no_ts), "vec": [values[i : i + d] for i, d in zip(begin[at], dim[at])]}

        kept = part(np.arange(max(0, len(order) - self.size + 1), len(order)))
        self.seen.update((n,))
        if len(kept["vec"]):
            self.held.put([(None if u is pd.NA else int(u), None if t is pd.NA else int(t), v.tolist()) for u, t, v in zip(kept["uid"], kept["ts"], kept["vec"])])
        elif self.held.exists():
            self.held.clear()
        # windows that these rows fill, in slices of what they hold
        first, last = max(0, -(-(before + 1 - self.size) // self.slide)), (n - self.size) // self.slide
        for k in range(0, (last - first + 1) * self.size, OUT_ROWS):
            row = np.arange(k, min(k + OUT_ROWS, (last - first + 1) * self.size))
            wid, slot = first + row // self.size, row % self.size
            yield pd.DataFrame({"key": key[0], "wid": wid, "slot": slot, **part(wid * self.slide + slot - before + h)})

    @staticmethod
    def _plain(frame: pd.DataFrame) -> tuple:
        """Numbers with nulls, twice; how long each vector is; their elements."""
        vec = [np.asarray(v, np.float64) for v in frame["vec"]]
        return _numbers(frame["uid"]), _numbers(frame["ts"]), np.fromiter(map(len, vec), np.int64, len(vec)), np.concatenate([np.zeros(0), *vec])

    def close(self) -> None:
        pass


def count_window(stream: DataFrame, size: int, slide: int | None = None, key: Column | None = None, kind: str = "tumbling") -> DataFrame:
    """key, wid, slot, uid, ts, vec: full count windows of each key's rows.

    Tumbling windows slide by their size, sliding ones by ``slide`` (1). Rows of a batch are taken by (ts, uid);
    without a key all rows are one sequence, which one task keeps: give streams that must scale a key.
    The session's queries use ``STATE_STORE`` from then on.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if size < 1 or (slide is not None and slide < 1):
        raise ValueError("sizes and slides are positive")
    step = size if kind == "tumbling" else slide or 1
    keyed = stream.select((F.lit(0) if key is None else key).cast("bigint").alias("key"), "uid", "ts", F.col("vec").cast("array<double>").alias("vec"))
    return keyed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_CountWindow(size, step, kind), outputStructType="key bigint, wid bigint, slot bigint, uid bigint, ts bigint, vec array<double>", outputMode="Append", timeMode="None"
    )


def similarity_join(left: DataFrame, right: DataFrame, window: int, threshold: float = 0.8, alpha: float = vectors.ALPHA, boundary: str = "inclusive") -> DataFrame:
    """l, r, ts, sim of two streams of records. The time band is an equality on buckets of the window's width,
    which spreads the state over keys, and watermarks of the window drop what can match no more."""
    width = max(1, window)
    a = left.select(F.struct("uid", "ts", "vec").alias("l"), event_time(F.col("ts") + EPOCH).alias("l_time")).withWatermark("l_time", f"{width} milliseconds")
    b = right.select(F.struct("uid", "ts", "vec").alias("r"), event_time(F.col("ts") + EPOCH).alias("r_time")).withWatermark("r_time", f"{width} milliseconds")
    a = a.withColumn("l_b", F.floor(F.col("l.ts") / width).cast("bigint"))
    b = b.withColumn("r_b", F.explode(F.array(*[F.floor(F.col("r.ts") / width).cast("bigint") + i for i in (-1, 0, 1)])))
    band = F.expr(f"l_b = r_b and l_time >= r_time - interval {width} milliseconds and l_time <= r_time + interval {width} milliseconds")
    dt = F.abs(F.col("l.ts") - F.col("r.ts"))
    pairs = a.join(b, band).where(dt <= window if boundary == "inclusive" else dt < window)
    pairs = pairs.withColumn("sim", vectors.similarity(F.col("l.vec"), F.col("r.vec"), alpha)).where(F.col("sim") >= threshold)
    return pairs.select(F.col("l.uid").alias("l"), F.col("r.uid").alias("r"), F.greatest("l.ts", "r.ts").alias("ts"), "sim")


def topk_batches(index: DataFrame, k: int, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the k nearest indexed records of each arriving query go to the sink. (Streams have no
    ranking of their own.)"""
    return lambda batch, number: sink(search.topk(batch, index, k), number)


def range_probe(stream: DataFrame, index: DataFrame, threshold: float, alpha: float = vectors.ALPHA) -> DataFrame:
    """qid, uid, sim: the records of a static index at least this similar to each arriving one. The index is broadcast and
    the stream passes through, so an index of more than ``PROBE_ROWS`` is an error; ``range_probe_batch`` takes any."""
    if index.limit(PROBE_ROWS + 1).count() > PROBE_ROWS:
        raise ValueError(f"an index of more than {PROBE_ROWS} records isn't broadcast; use range_probe_batch")
    return search.within(index, stream, threshold, alpha).select(F.col("uid").alias("qid"), F.col("qid").alias("uid"), "sim")


def range_probe_batch(index: DataFrame, threshold: float, alpha: float = vectors.ALPHA) -> Callable[[DataFrame], DataFrame]:
    """``range_probe`` for the batches of ``run_to_end``: blocks of the arriving records go to the executors, and the
    index is scanned there."""
    return lambda batch: search.within(batch, index, threshold, alpha)


def run_to_end(stream: DataFrame, batch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what there is and return what it wrote, exactly once: files of a checkpointed sink in
    the shared folder. batch: applied to each micro-batch before it is written."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if batch is None:
        query = writer.format("parquet").outputMode("append").start(f"{base}/out")
    else:
        # a batch that is run again replaces its own folder
        query = writer.foreachBatch(lambda df, n: batch(df).write.mode("overwrite").parquet(f"{base}/out/batch={n}")).start()
    query.awaitTermination()
    return _written(spark, f"{base}/out", stream if batch is None else None)


def _written(spark: SparkSession, path: str, like: DataFrame | None) -> DataFrame:
    if like is not None:
        return spark.read.schema(like.schema).parquet(path)
    return spark.read.parquet(path).drop("batch")

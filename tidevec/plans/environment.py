"""Fluent pipelines over records: sources, operators and sinks of an environment.

A ``Stream`` wraps a DataFrame, of a batch or of a stream; every operator gives a new one,
so a stream may be used several times (a true fan-out). Nothing runs until ``execute``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidevec.functions import vectors
from tidevec.operators import aggregate, index, join, topk, windows
from tidevec.session import shared_dir
from tidevec.sources.simple import SCHEMA, MemorySource
from tidevec.streaming import operators as streaming

Sink = Callable[[DataFrame], None]


class Stream:
    def __init__(self, env: Environment, df: DataFrame, name: str = "stream", step: int | None = None):
        self.env, self.df, self.name, self.step = env, df, name, step

    def _next(self, df: DataFrame, what: str, step: int | None = None) -> Stream:
        return Stream(self.env, df, f"{self.name}_{what}", step or self.step)

    def filter(self, condition: Column | str) -> Stream:
        """Rows that meet the condition; on windows too, rows really go."""
        return self._next(self.df.where(condition), "filter")

    def map(self, **columns: Column) -> Stream:
        """Columns with new values, all computed from the old ones."""
        return self._next(self.df.withColumns(columns), "map")

    def map_batches(self, function, schema: str) -> Stream:
        """For opaque code: a function over iterators of pandas frames."""
        return self._next(self.df.mapInPandas(function, schema), "map")

    def window(self, size: int, slide: int | None = None, kind: str = "tumbling", key: Column | None = None) -> Stream:
        """Count windows; 'base' passes rows through."""
        if kind == "base":
            return self
        if kind not in ("tumbling", "sliding"):
            raise ValueError(f"unknown kind of window {kind!r}")
        if self.df.isStreaming:
            return self._next(streaming.count_window(self.df, size, slide, key, kind), "window")
        if kind == "tumbling":
            return self._next(windows.tumbling(self.df, size, slide), "window")
        return self._next(windows.sliding(self.df, size, slide or 1), "window")

    def aggregate(self, kind: str = "avg") -> Stream:
        return self._next(aggregate.aggregate(self.df, kind), "aggregate")

    def topk(self, index_id: int | str, k: int) -> Stream:
        """The k nearest records of an index for each record of this stream."""
        return self._next(self.env.indexes.query(index_id, self.df, k), "topk")

    def itopk(self, query: list[float], k: int) -> Stream:
        """The k records of each window nearest to one query."""
        return self._next(topk.itopk(self.df, query, k), "itopk")

    def join(self, other: Stream, window: int | None = None, method: str = "bruteforce_lazy", threshold: float = 0.8, alpha: float = vectors.ALPHA, step: int | None = None, **options) -> Stream:
        """The windowed similarity join with another stream. window and step (milliseconds between the joins of a stream
        that goes on, see ``Environment.execute``): see ``join.window_and_step`` for what they are by default."""
        window, step = join.window_and_step(window, step)
        if self.df.isStreaming or other.df.isStreaming:
            join.parse_method(method)
            return self._next(streaming.similarity_join(self.df, other.df, window, threshold, alpha, **options), "join", step)
        return self._next(join.similarity_join(self.df, other.df, window, threshold, method, alpha, **options), "join", step)

    def write_sink(self, sink: Sink) -> Stream:
        """Hand the rows (of each micro-batch of a stream) to a function at ``execute``; rows also go on from here."""
        self.env._sinks.append((self, sink))
        return self

    def write_rows(self, callback: Callable[[dict], None]) -> Stream:
        """Call a function for each row, on the driver, a row at a time."""
        return self.write_sink(lambda df: [callback(r.asDict()) for r in df.toLocalIterator()] and None)


class Environment:
    def __init__(self, spark: SparkSession, config: dict | None = None, checkpoint: str | None = None):
        """checkpoint: a folder that all machines share, where the queries of streaming sinks keep how far they are; with the
        same folder, a new process goes on where the last one ended. By default a new one in the shared folder."""
        self.spark, self.config, self._checkpoint, self._started = spark, dict(config or {}), checkpoint, 0
        self.indexes = index.Registry(spark)
        self._sinks: list[tuple[Stream, Sink]] = []
        self._queries: list[StreamingQuery] = []
        self._streams: list[Stream] = []

    def add_stream(self, df: DataFrame | Stream, name: str = "stream") -> Stream:
        stream = df if isinstance(df, Stream) else Stream(self, df, name)
        self._streams.append(stream)
        return stream

    create_stream = add_stream

    def create_simple_source(self, name: str = "memory") -> MemorySource:
        return MemorySource(self.spark, name)

    def set_parallelism(self, n: int) -> None:
        """One setting for all operators."""
        self.spark.conf.set("spark.sql.shuffle.partitions", str(int(n)))

    def set_config(self, **values) -> None:
        self.config |= values

    def execute(self, trigger: dict | str | None = None) -> list[StreamingQuery]:
        """Run every sink registered since the last call: batches at once, streams as queries that go on.

        trigger: arguments of Spark's; 'step' for a micro-batch at each step of the stream's join; by default all there is
        and then the end. Each query has a checkpoint, numbered in the order of the sinks, so it starts again where it was
        and its sink sees a batch that failed once more.
        """
        todo, self._sinks = self._sinks, []
        started = []
        for stream, sink in todo:
            if stream.df.isStreaming:
                when = {"processingTime": f"{stream.step or join.STEP} milliseconds"} if trigger == "step" else trigger or {"availableNow": True}
                writer = stream.df.writeStream.trigger(**when).option("checkpointLocation", f"{self._folder()}/{self._started}-{stream.name}")
                self._started += 1
                started.append(writer.foreachBatch(lambda df, _, sink=sink: sink(df)).start())
            else:
                sink(stream.df)
        self._queries += started
        return started

    def _folder(self) -> str:
        self._checkpoint = self._checkpoint or f"{shared_dir(self.spark)}/environment-{uuid.uuid4().hex}"
        return self._checkpoint

    def await_termination(self) -> None:
        for query in self._queries:
            query.awaitTermination()

    def stop(self) -> None:
        for query in self._queries:
            query.stop()

    def reset(self) -> None:
        self.stop()
        self._sinks, self._queries, self._streams = [], [], []

    def get_stream_snapshot(self) -> dict:
        return {"streams_count": len(self._streams), "config": dict(self.config), "status": "active", "running": sum(q.isActive for q in self._queries)}


class Service:
    """A small service: vectors are pushed, and each ``run`` hands those pushed since to the sink."""

    def __init__(self, spark: SparkSession, dim: int, sink: Sink | None = None):
        self.env, self.dim = Environment(spark), dim
        self._source = self.env.create_simple_source("service")
        self._sink = sink or (lambda df: df.show(truncate=False))

    def push(self, uid: int, vec: list[float]) -> None:
        """A vector of the service's dimension."""
        shape = getattr(vec, "shape", (len(vec),))
        if tuple(shape) != (self.dim,):
            raise ValueError(f"a vector of shape ({self.dim},) expected, got {tuple(shape)}")
        self._source.add(uid, int(time.time() * 1000), list(vec))

    def set_sink(self, sink: Sink) -> None:
        self._sink = sink

    def run(self) -> int:
        """The number of rows handed over."""
        rows = self._source.drain()
        if rows:
            self.env.add_stream(self.env.spark.createDataFrame(rows, SCHEMA), "pushed").write_sink(self._sink)
            self.env.execute()
        return len(rows)


def create_stream_engine(spark: SparkSession, config: dict | None = None) -> Environment:
    return Environment(spark, config)


def create_vector_stream(env: Environment, df: DataFrame, name: str = "stream") -> Stream:
    return env.add_stream(df, name)


def create_simple_data_source(env: Environment, name: str = "memory") -> MemorySource:
    return env.create_simple_source(name)



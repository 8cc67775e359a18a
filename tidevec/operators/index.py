"""Indexes over records: a registry of named sets, exact search, inverted lists and hash tables.

An index is a DataFrame of records; inserting and erasing give a new one, as plans are
immutable. Inverted lists come from k-means; a query looks into the lists of its nearest
centroids. Records are stored by list when the index is built, and every
query reads them there. Results of every kind are ranked by exact distances.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidevec.functions import vectors
from tidevec.operators import topk as search
from tidevec.schema import record_schema
from tidevec.session import shared_dir

KINDS = ("bruteforce", "ivf", "hnsw", "vectraflow")
#: Rows that centroids are fitted on at most; every row is put into a list all the same.
FIT_ROWS = 200_000
#: Lists are fitted again when so many times as many records were added since as there are.
REBUILD = 1.5
#: Records that lie together at most, about, where all are in one list.
LIST_ROWS = 20_000


def fit_lists(rows: DataFrame, nlist: int, seed: int = 42, iterations: int = 20) -> np.ndarray:
    """Centroids (rows of a matrix) of at most nlist lists."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = rows.count()
    if not n:
        return np.zeros((0, 1))
    # rows are chosen by their content, so that any partitioning fits the same model
    share = rows if n <= FIT_ROWS else rows.where(F.xxhash64("vec") < F.lit(int(FIT_ROWS / n * 2**64) - 2**63))
    features = share.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, min(nlist, n)), maxIter=iterations, seed=seed).fit(features)
    return np.array(model.clusterCenters())


def _nearest_lists(vec: Column, centroids: np.ndarray, n: int) -> Column:
    """The n lists whose centroids are nearest, nearest first, by matrix products on Arrow batches."""
    shared = SparkSession.active().sparkContext.broadcast(centroids)

    def find(vectors_: pd.Series) -> pd.Series:
        c = shared.value
        norms = (c * c).sum(1)
        out = []
        for i in range(0, len(vectors_), 4096):
            x = np.stack(vectors_.iloc[i : i + 4096].to_numpy()).astype(np.float64)
            out += list(np.argsort(norms - 2 * x @ c.T, axis=1, kind="stable")[:, :n].astype(np.int32))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(find, "array<int>")(vec.cast("array<double>"))


def assign(df: DataFrame, vec: Column, centroids: np.ndarray, name: str = "list") -> DataFrame:
    """df with the list of its nearest centroid."""
    return df.withColumn(name, _nearest_lists(vec, centroids, 1)[0])


def probes(df: DataFrame, vec: Column, centroids: np.ndarray, nprobe: int, name: str = "list") -> DataFrame:
    """df once for each of the nprobe lists nearest to its vector."""
    return df.withColumn(name, F.explode(_nearest_lists(vec, centroids, max(1, min(nprobe, len(centroids))))))


def hash_tables(dim: int, tables: int, seed: int = 42, functions: int = 2):
    """Random projections: a function from a vector to its keys, one a table, in buckets of a length."""
    planes = np.random.default_rng(seed).normal(size=(tables, functions, dim))

    def keys(vec: Column, length: float) -> Column:
        out = []
        for t, group in enumerate(planes):
            parts = [F.floor(vectors.dot(vec, F.array(*[F.lit(float(x)) for x in p])) / length) for p in group]
            out.append(F.xxhash64(F.lit(t), *parts))
        return F.array(*out)

    return keys


@dataclass
class Index:
    """A named set of records with a way to search it."""

    name: str
    kind: str
    dim: int
    rows: DataFrame
    size: int = 0
    nlist: int = 1000
    nprobe: int = 10
    seed: int = 42
    centroids: np.ndarray | None = None
    added: int = 0  # records inserted since the lists were fitted
    listed: DataFrame | None = field(default=None, repr=False)  # the records by list

    def insert(self, rows: DataFrame) -> None:
        """Add records; of equal uids the one already there, or else the earliest, stays."""
        rows = rows.select("uid", "ts", "vec")
        both = self.rows.withColumn("_o", F.lit(0)).unionByName(rows.withColumn("_o", F.lit(1)))
        first = F.min_by(F.struct("uid", "ts", "vec"), F.struct("_o", "ts")).alias("r")
        # cut, so that a query doesn't run all insertions again
        shared_dir(rows.sparkSession)
        before = self.size
        self.rows = both.groupBy("uid").agg(first).select("r.*").checkpoint(eager=True)
        self.size = self.rows.count()
        self.added += self.size - before
        self.listed = None

    def erase(self, uids: DataFrame) -> None:
        """Remove the records with these uids (a column uid); others are ignored."""
        shared_dir(uids.sparkSession)
        self.rows = self.rows.join(uids.select("uid").distinct(), "uid", "left_anti").checkpoint(eager=True)
        self.size, self.listed = self.rows.count(), None

    def get(self, uids: DataFrame) -> DataFrame:
        """ordinal, uid, ts, vec for a list of uids (ordinal, uid): in its order, with repeats, without missing ones."""
        return uids.select("ordinal", "uid").join(self.rows, "uid").select("ordinal", "uid", "ts", "vec")

    def build(self) -> None:
        """Fit the inverted lists if there are none, or as many records were added since as ``REBUILD`` times those there
        are; and store the records by list, once for all queries."""
        if self.size and (self.centroids is None or self.added >= REBUILD * self.size):
            self.centroids, self.added = fit_lists(self.rows, self.nlist, self.seed), 0
        if self.listed is None and self.centroids is not None:
            shared_dir(self.rows.sparkSession)
            # a long list is dealt over several tasks, however many records it has
            part = F.pmod(F.xxhash64("uid"), F.lit(max(1, -(-self.size // LIST_ROWS))))
            listed = assign(self.rows.select("uid", F.col("vec").cast("array<double>").alias("vec")), F.col("vec"), self.centroids)
            self.listed = listed.repartition("list", part).sortWithinPartitions("list").checkpoint(eager=True)

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        """qid, rank, uid, dist of the k nearest. Inverted lists find those in the lists looked into: blocks of queries are
        broadcast with their lists, and each task compares its rows of a list with those who look into it. The other kinds
        are exact, ``hnsw`` too: a graph that changes row by row has no counterpart in immutable plans."""
        if self.kind != "ivf" or k <= 0:
            return search.topk(queries, self.rows, k)
        self.build()
        if self.listed is None:
            return search.topk(queries, self.rows, k)
        lists = _nearest_lists(F.col("vec"), self.centroids, max(1, min(self.nprobe, len(self.centroids))))
        return search.topk(queries.select("uid", "vec", lists.alias("lists")), self.listed, k)

    def query_for_join(self, queries: DataFrame, threshold: float, alpha: float = vectors.ALPHA) -> DataFrame:
        """qid, uid, sim of all records at least this similar."""
        return search.within(queries, self.rows, threshold, alpha)


class Registry:
    """Indexes by number and by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._by_id: dict[int, Index] = {}
        self._names: dict[str, int] = {}
        self._next = 0

    def create_index(self, name: str, kind: str = "bruteforce", dim: int = 0, **options) -> int:
        """The new index's number, or -1 for an unknown kind. A name that is taken is an error."""
        kind = (kind or "").lower()
        if kind not in KINDS:
            return -1
        if name in self._names:
            raise ValueError(f"there is an index {name!r}")
        number, self._next = self._next, self._next + 1
        self._by_id[number] = Index(name, kind, dim, self.spark.createDataFrame([], record_schema("float64")), **options)
        self._names[name] = number
        return number

    def __getitem__(self, key: int | str) -> Index:
        return self._by_id[self._names[key] if isinstance(key, str) else key]

    def insert(self, key: int | str, rows: DataFrame) -> bool:
        if not self._known(key):
            return False
        self[key].insert(rows.select("uid", "ts", F.col("vec").cast("array<double>").alias("vec")))
        return True

    def erase(self, key: int | str, uids: DataFrame) -> bool:
        if not self._known(key):
            return False
        self[key].erase(uids)
        return True

    def drop_index(self, key: int | str) -> bool:
        if not self._known(key):
            return False
        index = self._by_id.pop(self._names[key] if isinstance(key, str) else key)
        del self._names[index.name]
        return True

    def query(self, key: int | str, queries: DataFrame, k: int) -> DataFrame:
        return self[key].query(queries, k)

    def query_for_join(self, key: int | str, queries: DataFrame, threshold: float) -> DataFrame:
        return self[key].query_for_join(queries, threshold)

    def _known(self, key: int | str) -> bool:
        return (key in self._names) if isinstance(key, str) else key in self._by_id

    def save(self, key: int | str, path: str) -> None:
        """The records, and beside them the kind, the options and the centroids."""
        index = self[key]
        index.rows.write.mode("overwrite").parquet(f"{path}/rows")
        centroids = None if index.centroids is None else index.centroids.tolist()
        model = [(index.kind, index.dim, index.nlist, index.nprobe, index.seed, index.added, centroids)]
        self.spark.createDataFrame(model, _MODEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    def load(self, name: str, path: str) -> int:
        """A saved index under a new name, as it was."""
        m = self.spark.read.parquet(f"{path}/model").first()
        number = self.create_index(name, m["kind"], m["dim"], nlist=m["nlist"], nprobe=m["nprobe"], seed=m["seed"])
        index = self._by_id[number]
        index.rows, index.added = self.spark.read.parquet(f"{path}/rows"), m["added"]
        index.size, index.centroids = index.rows.count(), None if m["centroids"] is None else np.array(m["centroids"])
        return number


_MODEL = "kind string, dim int, nlist int, nprobe int, seed int, added bigint, centroids array<array<double>>"

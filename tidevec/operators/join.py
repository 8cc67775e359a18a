"""The windowed similarity join of two sets of records.

A pair (l, r) is joined if |l.ts - r.ts| <= window and exp(-alpha * distance) >=
threshold. The time band becomes an equality on buckets of the window's width, with the
right side in its own bucket and both neighbours, so rows meet by hash and never in a
nested loop; a bucket holds what one window holds. Buckets of many rows are divided into
blocks of both sides, and two blocks are compared by matrix products; the few pairs near
the threshold or over it get exact distances. Candidates of the approximate methods are
verified by the same predicate, so they lose pairs at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidevec.functions import vectors
from tidevec.operators.topk import SLOP, _exact, _matrix

#: Rows of one side in a block, about.
BLOCK = 2048
#: Milliseconds of a window, and of a step between joins, where neither is given.
WINDOW, STEP = 1000, 5
METHODS = ("bruteforce", "ivf", "lsh")


def window_and_step(window: int | None = None, step: int | None = None) -> tuple[int, int]:
    """What a join uses: ``WINDOW`` and ``STEP`` by default, and a quarter of a window that is given alone."""
    if window is None:
        return WINDOW, step or STEP
    return window, step or max(1, window // 4)


@dataclass(frozen=True)
class JoinMethod:
    index: str
    lazy: bool


def parse_method(name: str) -> JoinMethod:
    """'bruteforce' or 'bf', 'ivf' or 'lsh', with '_eager' or '_lazy' (the default): both evaluate the same
    relation; lazy names micro-batches of a stream, eager every arrival."""
    text = name.strip().lower()
    lazy = not text.endswith("_eager")
    stem = text.removesuffix("_eager").removesuffix("_lazy")
    stem = {"bf": "bruteforce"}.get(stem, stem)
    if stem not in METHODS:
        raise ValueError(f"unknown join method {name!r}; there are {', '.join(METHODS)}")
    return JoinMethod(stem, lazy)


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(d.select(F.struct("uid", "ts", "vec").alias(s)) for d, s in ((left, "l"), (right, "r")))


def _buckets(left: DataFrame, right: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with their time bucket; the right side in the neighbours too."""
    width = max(1, window)
    bucket = lambda c: F.floor(F.col(c) / width).cast("bigint")
    a = left.withColumn("_b", bucket("l.ts")).where("_b is not null")
    return a, right.withColumn("_b", F.explode(F.array(*[bucket("r.ts") + i for i in (-1, 0, 1)]))).where("_b is not null")


def _banded(left: DataFrame, right: DataFrame, window: int) -> DataFrame:
    """Pairs of one time bucket whose timestamps may be within the window."""
    a, b = _buckets(left, right, window)
    return a.join(b, "_b")


def _blocks(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with block numbers _i and _j: of each key's rows every left block meets every right one."""
    count = lambda d, n: d.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n))
    sizes = count(a, "_n").join(count(b, "_m"), keys)
    a, b = a.join(sizes, keys), b.join(sizes, keys)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = a.withColumn("_i", F.pmod(F.xxhash64("l.uid", "l.ts"), F.col("_n")).cast("int")).withColumn("_j", every("_m"))
    b = b.withColumn("_j", F.pmod(F.xxhash64("r.uid", "r.ts"), F.col("_m")).cast("int")).withColumn("_i", every("_n"))
    return a, b


def _similar(a: DataFrame, b: DataFrame, keys: list[str], window: int, strict: bool, threshold: float, alpha: float) -> DataFrame:
    """l, r (structs) and sim of the pairs within the band and the threshold."""
    reach = vectors.radius(threshold, alpha)
    a, b = _blocks(a, b, keys)
    flat = lambda d, s: d.select(*keys, "_i", "_j", F.col(f"{s}.uid").alias("uid"), F.col(f"{s}.ts").alias("ts"), F.col(f"{s}.vec").cast("array<double>").alias("vec"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"uid": pa.int64(), "ts": pa.int64(), "vec": pa.list_(pa.float64())}
        found = []
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            x, y = (_matrix(t.column("vec").combine_chunks() if isinstance(t.column("vec"), pa.ChunkedArray) else t.column("vec")) for t in (left, right))
            if x.shape[1] != y.shape[1]:
                raise ValueError(f"vectors of dimensions {x.shape[1]} and {y.shape[1]} meet")
            s, t = left.column("ts").to_numpy(), right.column("ts").to_numpy()
            yn = (y * y).sum(1)
            for k in range(0, len(x), 1024):
                part = x[k : k + 1024]
                norms = (part * part).sum(1)[:, None] + yn
                dt = np.abs(s[k : k + 1024, None] - t)
                near = (dt < window if strict else dt <= window) & (norms - 2 * part @ y.T - SLOP * (norms + 1) <= reach * reach)
                i, j = np.nonzero(near)
                sim = np.exp(-alpha * _exact(part, y, i, j))
                ok = sim >= threshold
                found.append((i[ok] + k, j[ok], sim[ok]))
        i, j, sim = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        columns = {f"{side}_{c}": t.column(c).take(pa.array(at)).cast(kind) for side, t, at in (("l", left, i), ("r", right, j)) for c, kind in kinds.items()}
        return pa.table(columns | {"sim": pa.array(sim, pa.float64())})

    group = [*keys, "_i", "_j"]
    made = flat(a, "l").groupBy(*group).cogroup(flat(b, "r").groupBy(*group)).applyInArrow(
        meet, "l_uid bigint, l_ts bigint, l_vec array<double>, r_uid bigint, r_ts bigint, r_vec array<double>, sim double"
    )
    whole = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("uid", "ts", "vec")]).alias(s)
    return made.select(whole("l"), whole("r"), "sim")


def similarity_join(
    left: DataFrame,
    right: DataFrame,
    window: int,
    threshold: float = 0.8,
    method: str = "bruteforce_lazy",
    alpha: float = vectors.ALPHA,
    boundary: str = "inclusive",
    project: list[Column] | None = None,
    residual: Column | None = None,
    nlist: int = 16,
    nprobe: int = 4,
    seed: int = 42,
    bucket_length: float = 2.0,
    tables: int = 4,
) -> DataFrame:
    """Joined pairs. Columns of ``project`` and ``residual`` see the structs l and r (uid, ts, vec) and sim;
    by default the result has l and r (the uids), ts (the later one) and sim.

    boundary: 'inclusive' joins |dt| <= window, 'half_open' |dt| < window. Null timestamps never match.
    """
    parsed = parse_method(method)
    if boundary not in ("inclusive", "half_open"):
        raise ValueError(f"unknown boundary {boundary!r}")
    a, b = _sides(left, right)
    keys = ["_b"]
    if parsed.index == "ivf":
        from tidevec.operators.index import assign, fit_lists, probes

        model = fit_lists(left.select("vec").unionByName(right.select("vec")), nlist, seed)
        if len(model):
            a = assign(a, F.col("l.vec"), model, "_list")
            b = probes(b, F.col("r.vec"), model, nprobe, "_list")
            keys.append("_list")
    elif parsed.index == "lsh":
        from tidevec.operators.index import hash_tables

        dim = left.select(F.size("vec")).first()
        planes = hash_tables(dim[0] if dim else 1, tables, seed)
        a, b = (d.withColumn("_h", F.explode(planes(F.col(f"{s}.vec"), bucket_length))) for d, s in ((a, "l"), (b, "r")))
        keys.append("_h")
    a, b = _buckets(a, b, window)
    pairs = _similar(a, b, keys, window, boundary == "half_open", threshold, alpha)
    if parsed.index == "lsh":
        pairs = pairs.dropDuplicates()
    if residual is not None:
        pairs = pairs.where(residual)
    if project is not None:
        return pairs.select(*project)
    return pairs.select(F.col("l.uid").alias("l"), F.col("r.uid").alias("r"), F.greatest("l.ts", "r.ts").alias("ts"), "sim")


def band_join(left: DataFrame, right: DataFrame, window: int, on: Column, project: list[Column]) -> DataFrame:
    """A join of records on the time band and any further predicate over the structs l and r."""
    a, b = _sides(left, right)
    pairs = _banded(a, b, window).where(F.abs(F.col("l.ts") - F.col("r.ts")) <= window)
    return pairs.where(on).select(*project)

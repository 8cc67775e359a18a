"""Synthetic input of similarity joins, with pairs of known similarity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidevec.schema import record_schema

#: What near pairs lie above or below the threshold, in similarity, and positive ones above it.
NEAR, ABOVE = 0.001, 0.05


@dataclass(frozen=True)
class Pairs:
    """How many pairs of each sort, and what they look like; times in milliseconds."""

    dim: int = 128
    positive: int = 500
    near: int = 50
    negative: int = 500
    tail: int = 2000
    threshold: float = 0.8
    alpha: float = 0.1
    seed: int = 42
    base_timestamp: int = 1_000_000
    interval: int = 100


#: Configurations that joins are tested with.
VARIANTS = {
    "basic_small_dataset": Pairs(dim=64, positive=20, near=0, negative=60, tail=0),
    "threshold_boundary_exact": Pairs(threshold=0.85, positive=30, near=20, negative=100, tail=0),
    "large_scale_test": Pairs(dim=256, threshold=0.75, positive=2000, near=0, negative=6000, tail=2000),
    "ivf_vs_bruteforce_consistency": Pairs(threshold=0.9, positive=200, near=0, negative=600, tail=200),
}


def join_pairs(spark: SparkSession, spec: Pairs = Pairs()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Left and right records, and the pairs made (l, r, sort, similar: whether they reach the threshold).

    Left vectors are random unit vectors. A positive partner lies at the distance that gives threshold + ABOVE, a near one
    at threshold + NEAR or - NEAR in turn, a negative one is another unit vector. Left uids are even, right ones odd;
    a pair's times differ by the interval. The tail is rows without a partner, on either side in turn.
    """
    rng = np.random.default_rng(spec.seed)

    def unit() -> np.ndarray:
        x = rng.normal(size=spec.dim)
        return x / np.linalg.norm(x)

    sides: tuple[list, list] = ([], [])
    made, ts = [], spec.base_timestamp
    sorts = ["positive"] * spec.positive + ["near"] * spec.near + ["negative"] * spec.negative
    for i, sort in enumerate(sorts):
        x = unit()
        if sort == "negative":
            y = unit()
        else:
            target = spec.threshold + (ABOVE if sort == "positive" else NEAR * (1 if i % 2 == 0 else -1))
            y = x + unit() * (-np.log(min(target, 1.0)) / spec.alpha)
        sim = float(np.exp(-spec.alpha * np.linalg.norm(x - y)))
        sides[0].append((2 * i + 2, ts, x.tolist()))
        sides[1].append((2 * i + 3, ts + spec.interval, y.tolist()))
        made.append((2 * i + 2, 2 * i + 3, sort, sim >= spec.threshold))
        ts += 2 * spec.interval
    for i in range(2 * len(sorts), 2 * len(sorts) + spec.tail):
        sides[i % 2].append((i + 2, ts, unit().tolist()))
        ts += spec.interval
    schema = record_schema("float64")
    return spark.createDataFrame(sides[0], schema), spark.createDataFrame(sides[1], schema), spark.createDataFrame(made, "l bigint, r bigint, sort string, similar boolean")

"""Connected components of a graph given as links, by alternating large and small stars.

Every round groups the links by an endpoint and points the neighbours at the
smallest one; minima are pre-aggregated before the shuffle, a round has as many tasks as
its links need, and each round is cut into the shared checkpoint folder, so a lost executor costs one round at most.
Nothing is collected to the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidevec.llm.common import cut, fewer

MAX_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another one; root is the smallest node reachable.

    links: any number of rows (null ends and links of a node to itself are left out), of any orderable type.
    """
    x, y = F.col(a), F.col(b)
    edges = links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u is not null and v is not null and u <> v and u is not null").distinct()
    edges = cut(edges)
    before = None
    for _ in range(MAX_ROUNDS):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        n, edges = state[0], fewer(edges, state[0])
        # large star: every larger neighbour of a node moves to the node's smallest neighbour (or the node itself)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = fewer(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n)
        large = fewer(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n)
        # small star: the smaller neighbours of a node, and the node, move to the smallest of them
        least = fewer(large.groupBy("u").agg(F.min("v").alias("m")), n)
        joined = large.join(least, "u")
        small = least.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = cut(fewer(small.distinct(), n))
    else:
        raise RuntimeError(f"the components didn't settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

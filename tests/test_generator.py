import time

import pytest
from pyspark.sql import functions as F

from tidevec.operators import index, join, topk
from tidevec.plans.environment import Environment
from tidevec.sources.generator import VARIANTS, Pairs, join_pairs


@pytest.mark.parametrize("spec", [VARIANTS["basic_small_dataset"], VARIANTS["threshold_boundary_exact"], Pairs(dim=10, positive=3, near=50, negative=4, tail=3)])
def test_generated_pairs_are_found(spark, spec):
    left, right, made = join_pairs(spark, spec)
    assert made.groupBy("sort").count().count() == len([n for n in (spec.positive, spec.near, spec.negative) if n])
    found = join.similarity_join(left, right, spec.interval, spec.threshold).select("l", "r")
    assert made.where("similar").join(found, ["l", "r"], "left_anti").count() == 0
    assert made.where("not similar").join(found, ["l", "r"], "left_semi").count() == 0
    near = {r.similar: r["count"] for r in made.where("sort = 'near'").groupBy("similar").count().collect()}
    assert near.get(True, 0) == near.get(False, 0) == spec.near // 2


def test_window_defaults():
    assert join.window_and_step() == (1000, 5)
    assert join.window_and_step(60_000) == (60_000, 15_000) and join.window_and_step(60_000, 1000) == (60_000, 1000)
    assert join.window_and_step(2) == (2, 1)


def test_index_is_saved_with_its_model(spark, tmp_path):
    left, _, _ = join_pairs(spark, VARIANTS["basic_small_dataset"])
    registry = index.Registry(spark)
    number = registry.create_index("a", "ivf", 64, nlist=4, nprobe=2)
    registry.insert(number, left)
    before = registry.query(number, left, 3).collect()
    registry.save(number, str(tmp_path / "saved"))
    other = registry.load("b", str(tmp_path / "saved"))
    assert (registry[other].kind, registry[other].nprobe) == ("ivf", 2) and (registry[other].centroids == registry[number].centroids).all()
    assert sorted(registry.query(other, left, 3).collect()) == sorted(before)
    # far fewer insertions than records: the lists stay; many: they are fitted again
    old = registry[other].centroids
    registry.insert(other, left.limit(5).withColumn("uid", F.col("uid") + 10**6))
    registry[other].build()
    assert registry[other].centroids is old and registry[other].listed.count() == 85


def test_tiles_change_nothing(spark, monkeypatch):
    left, right, _ = join_pairs(spark, VARIANTS["basic_small_dataset"])
    want, near = sorted(topk.topk(left, right, 5).collect()), sorted(topk.within(left, right, 0.85).collect())
    monkeypatch.setattr(topk, "TILE", 7)
    assert sorted(topk.topk(left, right, 5).collect()) == want and sorted(topk.within(left, right, 0.85).collect()) == near


def test_streams_go_on_where_they_were(spark, tmp_path):
    rows = [(i, i, [float(i)]) for i in range(6)]
    folder, seen = tmp_path / "in", []
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "uid bigint, ts bigint, vec array<double>").coalesce(1).write.mode("append").parquet(str(folder))
        env = Environment(spark, checkpoint=str(tmp_path / "state"))
        stream = spark.readStream.schema("uid bigint, ts bigint, vec array<double>").parquet(str(folder))
        env.add_stream(stream).write_sink(lambda df: seen.extend(r.uid for r in df.collect()))
        env.execute()
        env.await_termination()
    assert sorted(seen) == list(range(6))
    # a micro-batch at each step
    env = Environment(spark)
    env.add_stream(spark.readStream.schema("uid bigint, ts bigint, vec array<double>").parquet(str(folder))).write_sink(lambda df: None)
    (query,) = env.execute("step")
    assert query.isActive
    time.sleep(1)
    env.stop()

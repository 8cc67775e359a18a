import math

import pytest
from pyspark.sql import functions as F

from tidevec.functions import vectors as v
from tidevec.schema import records


def value(spark, make, kind="double", **arrays):
    df = spark.createDataFrame([tuple(arrays.values())], ", ".join(f"{k} array<{kind}>" for k in arrays))
    return df.select(make(F.col("a"), F.col("b")).alias("x")).first()["x"]





def test_known_distance(spark):
    assert value(spark, lambda A, B: v.l2(A, B), a=[0.0, 0.0], b=[3.0, 4.0]) == 5.0
    assert value(spark, lambda A, B: v.similarity(A, B), a=[0.0, 0.0], b=[3.0, 4.0]) == pytest.approx(math.exp(-0.5))


def test_identical_and_empty(spark):
    assert value(spark, lambda A, B: v.similarity(A, B, 0.5), a=[1.0, 2.0, 3.0], b=[1.0, 2.0, 3.0]) == 1.0
    assert value(spark, lambda A, B: v.similarity(A, B), a=[], b=[]) == 1.0


def test_nearer_is_more_similar(spark):
    near = value(spark, lambda A, B: v.similarity(A, B), a=[0.0] * 3, b=[1.0] * 3)
    far = value(spark, lambda A, B: v.similarity(A, B), a=[0.0] * 3, b=[2.0] * 3)
    assert near > far


def test_unequal_dimensions_are_an_error(spark):
    with pytest.raises(Exception, match="dimensions 2 and 3"):
        value(spark, lambda A, B: v.l2(A, B), a=[1.0, 2.0], b=[1.0, 2.0, 3.0])


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint", "float", "double"])
def test_all_element_types(spark, kind):
    whole = [1, 2] if kind not in ("float", "double") else [1.0, 2.0]
    more = [4, 6] if kind not in ("float", "double") else [4.0, 6.0]
    assert value(spark, lambda A, B: v.l2(A, B), kind, a=whole, b=more) == 5.0
    assert value(spark, lambda A, B: v.dot(A, B), kind, a=whole, b=more) == 16.0
    assert value(spark, lambda A, B: v.sq_norm(A), kind, a=whole, b=more) == 5.0


def test_normalize_cosine_mean_concat(spark):
    assert value(spark, lambda A, B: v.normalize(A), a=[3.0, 4.0], b=[0.0]) == [0.6, 0.8]
    assert value(spark, lambda A, B: v.normalize(A), a=[0.0, 0.0], b=[0.0]) == [0.0, 0.0]
    assert value(spark, lambda A, B: v.cosine(A, B), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(1 / math.sqrt(2))
    assert value(spark, lambda A, B: v.cosine(A, B), a=[0.0, 0.0], b=[1.0, 1.0]) is None
    assert value(spark, lambda A, B: v.mean2(A, B), a=[1.0, 3.0], b=[3.0, 5.0]) == [2.0, 4.0]
    assert value(spark, lambda A, B: v.concat(A, B), a=[1.0], b=[2.0, 3.0]) == [1.0, 2.0, 3.0]
    assert value(spark, lambda A, B: v.equal(A, B), a=[1.0], b=[1.0]) is True


def test_combined_uid(spark):
    made = spark.range(1).select(v.combined_uid(F.lit(12), F.lit(34)).alias("u"))
    left, right = v.split_uid(F.col("u"))
    assert tuple(made.select("u", left, right).first()) == (12_000_034, 12, 34)


def test_radius_is_the_inverse_of_similarity():
    assert math.exp(-0.1 * v.radius(0.8)) == pytest.approx(0.8)
    assert v.radius(0) == math.inf


def test_records_drop_what_is_no_record(spark):
    df = spark.createDataFrame([(1, 1, [1.0]), (None, 1, [1.0]), (2, 1, None), (3, None, [None])], "uid long, ts long, vec array<double>")
    assert [r.uid for r in records(df).collect()] == [1]
    with pytest.raises(Exception, match="dimension 2 expected"):
        records(df, dim=2).collect()
    with pytest.raises(ValueError):
        records(df, vec="ts")


def test_render(spark):
    line = spark.range(1).select(v.render(F.lit(1), F.lit(2), F.array(F.lit(0.5), F.lit(1.25))).alias("x")).first()["x"]
    assert line == "uid=1 ts=2 [0.500000, 1.250000]"

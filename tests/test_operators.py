import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidevec.operators import aggregate, index, join, order, topk, windows
from tidevec.plans.metrics import quality

S = "uid long, ts long, vec array<double>"


def rows(spark, n, dim=4, seed=1, step=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, i * step, x.tolist()) for i, x in enumerate(rng.normal(size=(n, dim)))], S)


def local(df):
    return {r.uid: (r.ts, np.array(r.vec)) for r in df.collect()}


def test_positions_are_the_global_order(spark):
    random.seed(2)
    data = [(i, random.choice([0, 5, 5, 9, random.randrange(1000)]), [0.0]) for i in range(500)]
    df = spark.createDataFrame(data, S).repartition(7)
    want = {u: p for p, (u, _, _) in enumerate(sorted(data, key=lambda r: (r[1], r[0])))}
    assert {r.uid: r.pos for r in order.positions(df).collect()} == want
    back = {u: len(data) - 1 - p for u, p in want.items()}
    assert {r.uid: r.pos for r in order.positions(df, descending=True).collect()} == back


def test_tumbling_windows_drop_the_last_part(spark):
    got = windows.tumbling(rows(spark, 100), 30).groupBy("wid").count().collect()
    assert {r["wid"]: r["count"] for r in got} == {0: 30, 1: 30, 2: 30}
    assert windows.tumbling(rows(spark, 100), 30, keep_partial=True).count() == 100
    assert windows.tumbling(rows(spark, 10), 30).count() == 0
    with pytest.warns(UserWarning):
        windows.tumbling(rows(spark, 4), 2, slide=1)
    with pytest.raises(ValueError):
        windows.tumbling(rows(spark, 4), 0)


@pytest.mark.parametrize("n,size,slide", [(25, 10, 1), (25, 10, 5), (25, 10, 7), (9, 10, 1), (10, 10, 3), (20, 3, 5)])
def test_sliding_windows(spark, n, size, slide):
    got = {(r.wid, r.slot): r.uid for r in windows.sliding(rows(spark, n), size, slide).collect()}
    want = {(w, s): w * slide + s for w in range(max(0, (n - size) // slide + 1)) for s in range(size)}
    assert got == want


def test_aggregates(spark):
    df = rows(spark, 60)
    w = windows.tumbling(df, 20)
    known = local(df)
    for r in aggregate.aggregate(w, "avg").collect():
        members = range(r.wid * 20, r.wid * 20 + 20)
        assert r.uid == r.wid * 20 and np.allclose(r.vec, np.mean([known[i][1] for i in members], 0))
    for r in aggregate.aggregate(w, "sum").collect():
        assert np.allclose(r.vec, np.sum([known[i][1] for i in range(r.wid * 20, r.wid * 20 + 20)], 0))
    assert {r.uid for r in aggregate.aggregate(w, "first").collect()} == {0, 20, 40}
    assert {r.n for r in aggregate.aggregate(w, "count").collect()} == {20}
    with pytest.raises(ValueError):
        aggregate.aggregate(df, "avg")
    with pytest.raises(ValueError):
        aggregate.aggregate(w, "median")


def brute_topk(queries, base, k):
    q, b = local(queries), local(base)
    return {(i, rank): u for i, (_, x) in q.items() for rank, (_, u) in enumerate(sorted((float(np.sqrt(((x - y) ** 2).sum())), u) for u, (_, y) in b.items())[:k], 1)}


@pytest.mark.parametrize("k", [1, 5, 40])
def test_topk_is_exact(spark, monkeypatch, k):
    base, queries = rows(spark, 30, seed=3), rows(spark, 7, seed=4)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 100)  # several blocks
    got = {(r.qid, r["rank"]): r.uid for r in topk.topk(queries, base.repartition(3), k).collect()}
    assert got == brute_topk(queries, base, k)


def test_topk_ties_and_edges(spark):
    base = spark.createDataFrame([(i, 0, [1.0, 1.0]) for i in (5, 3, 9)], S)
    q = spark.createDataFrame([(1, 0, [0.0, 0.0])], S)
    assert [r.uid for r in topk.topk(q, base, 2).orderBy("rank").collect()] == [3, 5]
    assert topk.topk(q, base, 0).count() == 0
    assert topk.topk(q, base.where("uid < 0"), 3).count() == 0
    assert topk.topk(q.where("uid < 0"), base, 3).count() == 0
    assert [r.uid for r in topk.topk(base, base, 1, exclude_self=True).orderBy("qid").collect()] == [5, 3, 3]
    with pytest.raises(Exception, match="dimensions"):
        topk.topk(q, spark.createDataFrame([(1, 0, [1.0])], S), 1).collect()


def test_range_and_recall(spark):
    base = rows(spark, 50, seed=5)
    q = base.where("uid % 10 = 0")
    b = local(base)
    want = {(i, j) for i in range(0, 50, 10) for j in b if np.exp(-0.1 * np.linalg.norm(b[i][1] - b[j][1])) >= 0.8}
    assert {(r.qid, r.uid) for r in topk.within(q, base, 0.8).collect()} == want
    truth = topk.topk(q, base, 4)
    assert topk.recall(truth, truth, 4).first()["recall"] == 1.0
    assert topk.recall(truth.where("rank <= 3"), truth, 4).first()["recall"] == 0.75


def brute_join(a, b, window, threshold, strict=False):
    out = set()
    for i, (s, x) in local(a).items():
        for j, (t, y) in local(b).items():
            close = abs(s - t) < window if strict else abs(s - t) <= window
            if close and np.exp(-0.1 * np.linalg.norm(x - y)) >= threshold:
                out.add((i, j))
    return out


@pytest.mark.parametrize("window", [0, 1, 7, 30, 1000])
def test_similarity_join(spark, window):
    a, b = rows(spark, 60, seed=6, step=3), rows(spark, 50, seed=7, step=4)
    for boundary in ("inclusive", "half_open"):
        got = {(r.l, r.r) for r in join.similarity_join(a, b, window, 0.8, boundary=boundary).collect()}
        assert got == brute_join(a, b, window, 0.8, boundary == "half_open")


def test_join_negative_times_and_symmetry(spark):
    a, b = rows(spark, 40, seed=6).withColumn("ts", F.col("ts") - 20), rows(spark, 40, seed=7).withColumn("ts", F.col("ts") - 25)
    one = {(r.l, r.r) for r in join.similarity_join(a, b, 6, 0.75).collect()}
    other = {(r.r, r.l) for r in join.similarity_join(b, a, 6, 0.75).collect()}
    assert one == other == brute_join(a, b, 6, 0.75)


def test_approximate_methods_only_lose_pairs(spark):
    a, b = rows(spark, 80, seed=8), rows(spark, 80, seed=9)
    truth = join.similarity_join(a, b, 20, 0.85)
    full = join.similarity_join(a, b, 20, 0.85, "ivf_eager", nlist=4, nprobe=4)
    assert quality(full, truth, ["l", "r"]).first().asDict() == {"recall": 1.0, "precision": 1.0, "f1": 1.0}
    for method in ("ivf_lazy", "lsh_lazy"):
        q = quality(join.similarity_join(a, b, 20, 0.85, method, nlist=4, nprobe=3, bucket_length=6.0, tables=8), truth, ["l", "r"]).first()
        assert q["precision"] == 1.0 and q["recall"] >= 0.5


def test_join_projection_and_residual(spark):
    a, b = rows(spark, 30, seed=8), rows(spark, 30, seed=9)
    got = join.similarity_join(a, b, 5, 0.7, residual=F.col("l.uid") % 2 == 0, project=[(F.col("l.uid") * 1000 + F.col("r.uid")).alias("u")])
    assert {r.u for r in got.collect()} == {i * 1000 + j for i, j in brute_join(a, b, 5, 0.7) if i % 2 == 0}


def test_method_names():
    assert join.parse_method("BF_Eager") == join.JoinMethod("bruteforce", False)
    assert join.parse_method("ivf") == join.JoinMethod("ivf", True)
    with pytest.raises(ValueError):
        join.parse_method("magic_eager")


def test_registry(spark):
    registry = index.Registry(spark)
    base = rows(spark, 40, seed=10)
    assert registry.create_index("x", "unknown") == -1
    number = registry.create_index("x", "ivf", 4, nlist=4, nprobe=4)
    assert registry.insert(number, base) and not registry.insert(99, base)
    registry.insert(number, base.withColumn("ts", F.lit(-1).cast("long")))
    assert registry[number].rows.where("ts = -1").count() == 0
    registry.erase("x", base.where("uid < 5").select("uid"))
    q = rows(spark, 3, seed=11)
    got = {(r.qid, r["rank"]): r.uid for r in registry.query(number, q, 3).collect()}
    assert got == brute_topk(q, base.where("uid >= 5"), 3)
    asked = spark.createDataFrame([(0, 7), (1, 2), (2, 7)], "ordinal long, uid long")
    assert [(r.ordinal, r.uid) for r in registry[number].get(asked).orderBy("ordinal").collect()] == [(0, 7), (2, 7)]
    with pytest.raises(ValueError):
        registry.create_index("x")
    assert registry.drop_index("x") and not registry.drop_index("x")


def test_itopk(spark):
    df = rows(spark, 40, seed=12)
    got = topk.itopk(windows.tumbling(df, 20), [0.0] * 4, 3).collect()
    known = local(df)
    for w in (0, 1):
        want = [u for _, u in sorted((float(np.linalg.norm(known[i][1])), i) for i in range(w * 20, w * 20 + 20))[:3]]
        assert [r.uid for r in sorted(got, key=lambda r: r["rank"]) if r.wid == w] == want


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_events_without_ids_and_hours_that_a_zone_leaves_out(spark, tmp_path, zone):
    """Rows without an id are joined as in SQL, and no zone moves times without one (02:30 of 10 March is missing in New York)."""
    import duckdb

    from tidevec.plans import catalogue

    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        con = duckdb.connect()
        con.sql(
            """CREATE TABLE events AS SELECT * FROM (VALUES
            (1, TIMESTAMP '2024-03-10 02:30:00', 'click', 1.0), (2, TIMESTAMP '2024-03-10 03:20:00', 'view', 1.0), (3, TIMESTAMP '2024-03-10 04:10:00', 'view', 1.0),
            (NULL, TIMESTAMP '2024-01-01 10:00:00', 'click', 2.0), (4, TIMESTAMP '2024-01-01 10:30:00.000999', 'view', 3.0), (NULL, TIMESTAMP '1969-12-31 23:59:59.9995', 'view', 2.0),
            (5, TIMESTAMP '1970-01-01 00:59:59.999', 'click', 2.0), (6, NULL, 'view', 2.0), (7, TIMESTAMP '2024-01-01 10:00:00', 'view', NULL)) t(event_id, ts, event_type, value)"""
        )
        con.sql(f"COPY events TO '{tmp_path}/events.parquet'")
        want = con.sql(catalogue.ORACLES["events_band_join"]).fetchall()
        got = [tuple(r) for r in catalogue.QUERIES["events_band_join"](spark, str(tmp_path)).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_event_times_are_rounded_to_milliseconds_as_in_sql(spark, tmp_path):
    """Half a millisecond and more counts as a whole one: pairs at the edge of the band come or go with it, before 1970 too."""
    import duckdb

    from tidevec.plans import catalogue

    con = duckdb.connect()
    con.sql(
        """CREATE TABLE events AS SELECT * FROM (VALUES
        (1, TIMESTAMP '2024-01-01 10:00:00.000600', 'click', 1.0), (2, TIMESTAMP '2024-01-01 11:00:00.001400', 'view', 1.0),
        (3, TIMESTAMP '2024-01-02 10:00:00.000400', 'click', 1.0), (4, TIMESTAMP '2024-01-02 11:00:00.000500', 'view', 1.0),
        (5, TIMESTAMP '1969-12-01 10:00:00.000400', 'click', 1.0), (6, TIMESTAMP '1969-12-01 11:00:00.000500', 'view', 1.0),
        (7, TIMESTAMP '1969-12-02 10:00:00.000500', 'click', 1.0), (8, TIMESTAMP '1969-12-02 11:00:00.000499', 'view', 1.0),
        (9, TIMESTAMP '1969-12-31 23:59:59.999600', 'click', 1.0), (10, TIMESTAMP '1970-01-01 01:00:00.000499', 'view', 1.0)) t(event_id, ts, event_type, value)"""
    )
    con.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    want = con.sql(catalogue.ORACLES["events_band_join"]).fetchall()
    got = [tuple(r) for r in catalogue.QUERIES["events_band_join"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    ms = con.sql("SELECT event_id, epoch_ms(ts) FROM events").fetchall()
    assert sorted((r.uid, r.ts) for r in catalogue.V(spark, str(tmp_path)).collect()) == sorted(ms)


def peak_mb(job):
    import tracemalloc

    tracemalloc.start()
    try:
        job()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def tasks_run_here(monkeypatch, index_rows):
    """Run what mapInArrow would give to a task in this process, on these rows."""
    import pyarrow as pa
    import pyspark.sql.classic.dataframe

    uid, x = index_rows
    ran = []

    def here(self, run, schema):
        batch = pa.RecordBatch.from_arrays([pa.array(uid), pa.array(list(x)), pa.array(np.zeros(len(uid), np.int32))], ["uid", "vec", "list"])
        ran.append(peak_mb(lambda: [None for _ in run(iter([batch]))]))
        return self.sparkSession.createDataFrame([], schema)

    monkeypatch.setattr(pyspark.sql.classic.dataframe.DataFrame, "mapInArrow", here)
    return ran


def test_memory_of_lists_is_that_of_tiles(spark, monkeypatch):
    """3,000 queries meet a list of 6,000 copies of one vector."""
    x = np.tile(np.arange(32.0), (6000, 1))
    base = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x[:50])], S)
    queries = spark.range(3000).select(F.col("id").alias("uid"), F.lit(0).cast("long").alias("ts"), F.array(*[F.lit(float(i)) for i in range(32)]).alias("vec"))
    own = index.Index("a", "ivf", 32, base, size=50, centroids=np.vstack([x[0], x[0] + 50]), nprobe=2)
    own.build()
    ran = tasks_run_here(monkeypatch, (np.arange(6000), x))
    own.query(queries, 10)
    assert ran and max(ran) < 150


def test_equal_vectors_in_lists_rank_by_uid(spark):
    base = spark.createDataFrame([(i, 0, [1.0, float(i >= 300)]) for i in range(400)], S)
    own = index.Index("a", "ivf", 2, base, size=400, nlist=2, nprobe=2)
    got = own.query(base.where("uid in (5, 399)"), 3)
    assert sorted((r.qid, r["rank"], r.uid) for r in got.collect()) == [(5, 1, 0), (5, 2, 1), (5, 3, 2), (399, 1, 300), (399, 2, 301), (399, 3, 302)]


def test_memory_of_a_range_search_is_that_of_tiles(spark, monkeypatch):
    """All of 2,000 x 2,000 pairs are near: their vectors side by side took 2 GB."""
    x = np.tile(np.arange(32.0), (2000, 1))
    queries = spark.range(2000).select(F.col("id").alias("uid"), F.lit(0).cast("long").alias("ts"), F.array(*[F.lit(float(i)) for i in range(32)]).alias("vec"))
    ran = tasks_run_here(monkeypatch, (np.arange(2000), x))
    topk.within(queries, queries, 0.9)
    assert ran and max(ran) < 150


def test_memory_of_a_block_of_queries(spark):
    """30,000 queries of 64 dimensions, 15 MB, were one block that each Python worker held."""
    queries = spark.range(30_000).select(F.col("id").alias("uid"), F.array(*[F.col("id") + float(i) for i in range(64)]).alias("vec"))
    blocks = [b.value for b in topk._blocks(queries)]
    assert sorted(np.concatenate([qid for qid, _, _ in blocks]).tolist()) == list(range(30_000))
    assert len(blocks) > 1 and max(q.nbytes for _, q, _ in blocks) < 10_000_000

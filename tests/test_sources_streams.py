import struct

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidevec.operators import join, topk, windows
from tidevec.plans import catalogue, config, environment, metrics
from tidevec.sources import binary, simple
from tidevec.streaming import operators as streaming

S = "uid long, ts long, vec array<double>"


def test_binary_round_trip():
    for element in binary._NUMPY:
        for header in ("none", "count"):
            rows = [(1, 100, [10, 20]), (2**63 + 5, -7, []), (3, 0, [1, 2, 3])]
            got = binary.decode(binary.encode(rows, element, header), header)
            assert [(u & (2**64 - 1), t, v.tolist()) for u, t, v in got] == rows
    raw = binary.encode([(1, 1, [1.0]), (2, 2, [2.0])])
    assert len(binary.decode(raw[:-1])) == 1
    with pytest.raises(ValueError):
        binary.decode(struct.pack("<Qqii", 1, 1, 1, 77) + b"\0\0\0\0")
    assert [v.tolist() for _, _, v in binary.decode_fvecs(binary.encode_fvecs([[1.0, 2.0], [3.0, 4.0]]))] == [[1.0, 2.0], [3.0, 4.0]]


def test_files(spark, tmp_path):
    rows = [(i, i + 10000, [float(i), 2.0 * i, 3.0 * i, 4.0 * i]) for i in range(1500)]
    (tmp_path / "a.bin").write_bytes(binary.encode(rows, header="count"))
    assert binary.read_vecbin(spark, str(tmp_path / "a.bin"), header="count").count() == 1500
    back = [r.uid for r in binary.read_vecbin(spark, str(tmp_path / "a.bin"), header="count", order="desc").collect()]
    assert back == list(range(1499, -1, -1))
    assert binary.read_vecbin(spark, str(tmp_path / "missing.bin")).count() == 0
    (tmp_path / "a.fvecs").write_bytes(binary.encode_fvecs([r[2] for r in rows[:10]]))
    assert [(r.uid, r.ts) for r in binary.read_fvecs(spark, str(tmp_path / "a.fvecs")).collect()] == [(i, i) for i in range(10)]
    out = str(tmp_path / "out")
    df = spark.createDataFrame(rows, S).repartition(3)
    assert binary.write_vecbin(df, out) == 1500
    assert {tuple(r.vec) for r in binary.read_vecbin(spark, out).collect()} == {tuple(r[2]) for r in rows}
    got = streaming.run_to_end(binary.stream_vecbin(spark, out, max_files=1))
    assert got.count() == 1500


def test_csv_and_memory_and_fan_out(spark, tmp_path):
    (tmp_path / "v.csv").write_text("id,dim1,dim2\n1,0.5,0.25\n2,0.1,0.2\n")
    assert [(r.uid, r.vec) for r in simple.read_csv(spark, str(tmp_path / "v.csv"), 2).collect()] == [(1, [0.5, 0.25]), (2, [0.1, 0.2])]
    source = simple.MemorySource(spark, limit=2)
    source.add(1, 5, [1.0])
    source.add(2, None, [2.0])
    with pytest.raises(BufferError):
        source.add(3, 1, [1.0])
    assert source.dataframe().count() == 2
    dealt = simple.fan_out(spark.createDataFrame([(i, i, [0.0]) for i in range(10)], S), "hash", 4)
    assert [d.count() for d in dealt] == [3, 3, 2, 2]
    assert len(simple.fan_out(source.dataframe(), "broadcast", 2)) == 2


@pytest.fixture
def feed(spark, tmp_path):
    df = spark.createDataFrame([(i, i, [float(i % 7), float(i % 3)]) for i in range(90)], S)
    for k in range(3):
        df.where(f"uid div 30 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, simple.stream_parquet(spark, str(tmp_path / "in"), df.schema, max_files=1)


def test_stream_windows_equal_batch(spark, feed):
    df, stream = feed
    one = spark.createDataFrame([(i, i, [float(i)]) for i in range(55)], S)
    for kind, batch in (("tumbling", windows.tumbling(one, 10)), ("sliding", windows.sliding(one, 10, 4))):
        path = streaming.shared_dir(spark) + f"/w-{kind}"
        one.coalesce(1).write.mode("overwrite").parquet(path)
        got = streaming.run_to_end(streaming.count_window(simple.stream_parquet(spark, path, one.schema), 10, 4, kind=kind))
        assert {(r.wid, r.slot, r.uid) for r in got.collect()} == {(r.wid, r.slot, r.uid) for r in batch.collect()}
    keyed = streaming.run_to_end(streaming.count_window(stream, 4, key=F.col("uid") % 3))
    sizes = {(r.key, r.wid): r["count"] for r in keyed.groupBy("key", "wid").count().collect()}
    assert sizes == {(k, w): 4 for k in range(3) for w in range(7)}


def test_stream_join_equals_batch(spark, feed):
    df, stream = feed
    batch = join.similarity_join(df.where("uid % 2 = 0"), df.where("uid % 2 = 1"), 100, 0.85)
    got = streaming.run_to_end(streaming.similarity_join(stream.where("uid % 2 = 0"), stream.where("uid % 2 = 1"), 100, 0.85))
    assert {(r.l, r.r) for r in got.collect()} == {(r.l, r.r) for r in batch.collect()}


def test_stream_topk_and_probe(spark, feed):
    df, stream = feed
    base = df.where("uid < 20")
    got = streaming.run_to_end(stream, lambda b: topk.topk(b, base, 2))
    assert {(r.qid, r["rank"], r.uid) for r in got.collect()} == {(r.qid, r["rank"], r.uid) for r in topk.topk(df, base, 2).collect()}
    probed = streaming.run_to_end(streaming.range_probe(stream, base, 0.95))
    assert {(r.qid, r.uid) for r in probed.collect()} == {(r.qid, r.uid) for r in topk.within(df, base, 0.95).collect()}


def test_stream_range_probe_sends_only_the_probes(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    sent, blocks = [], topk._blocks
    monkeypatch.setattr(topk, "_blocks", lambda queries: sent.append(queries.count()) or blocks(queries))
    got = entry.queries()["stream_range_probe"](spark, sf)
    base = catalogue.E(spark, sf)
    want = topk.within(catalogue._queries(base), base, 0.9)
    sent = sent[:-1]
    assert {(r.qid, r.uid) for r in got.collect()} == {(r.qid, r.uid) for r in want.collect()} and got.count() > 0
    assert sum(sent) and max(sent) * 10 < spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_pipelines(spark):
    env = environment.create_stream_engine(spark, {"a": 1})
    df = spark.createDataFrame([(i, i, [float(i + 0.1 * j) for j in range(4)]) for i in range(100)], S)
    seen = []
    root = environment.create_vector_stream(env, df)
    doubled = root.filter("uid % 2 = 0").map(uid=F.col("uid") * 10)
    doubled.write_rows(lambda r: seen.append(r["uid"]))
    averages = []
    root.window(50).aggregate("avg").write_sink(lambda d: averages.extend(d.collect()))
    env.execute()
    assert sorted(seen) == [i * 10 for i in range(0, 100, 2)] and len(averages) == 2
    few = env.add_stream(spark.createDataFrame([(i, i, [0.0]) for i in range(80)], S))
    chained = few.filter("uid % 3 = 0").map(uid=F.col("uid") + 1000).filter("uid < 1050").map(uid=F.col("uid") * 2)
    assert chained.df.count() == 17
    number = env.indexes.create_index("i", "bruteforce", 3)
    env.indexes.insert(number, spark.createDataFrame([(1, 1, [1.0, 2.0, 3.0]), (2, 2, [4.0, 5.0, 6.0]), (3, 3, [7.0, 8.0, 9.0])], S))
    q = env.add_stream(spark.createDataFrame([(9, 9, [1.0, 2.0, 4.0])], S))
    assert [r.uid for r in q.topk(number, 2).df.orderBy("rank").collect()] == [1, 2]
    assert q.window(1, kind="base") is q
    assert root.window(10).itopk([0.0] * 4, 3).df.count() == 30
    assert root.join(root, 2, "bf_eager", 0.9).df.count() > 0
    assert env.get_stream_snapshot()["config"] == {"a": 1}
    assert env.execute() == []


def test_service(spark):
    got = []
    service = environment.Service(spark, 2, lambda d: got.extend(d.collect()))
    service.push(1, [1.0, 2.0])
    with pytest.raises(ValueError):
        service.push(2, [1.0])
    assert service.run() == 1 and service.run() == 0
    service.push(3, [1.0, 2.0])
    assert service.run() == 1 and [r.uid for r in got] == [1, 3]


def test_config_and_metrics(spark, tmp_path, monkeypatch):
    path = tmp_path / "c.toml"
    path.write_text('a = 1\nb = "x"\nlist = [1]\n[t]\nc = 2.5\n[[cases]]\nn = 1\n[[cases]]\nn = 2\n')
    assert config.load(str(path)) == {"a": 1, "b": "x"}
    assert config.load_nested(str(path)) == {"a": 1, "b": "x", "list": [1], "t.c": 2.5, "cases": [{"n": 1}, {"n": 2}]}
    assert config.log_level({"log_level": "info"}) == "INFO"
    monkeypatch.setenv("TIDEVEC_LOG_LEVEL", "error")
    assert config.log_level({"log_level": "info"}) == "ERROR"
    with pytest.raises(ValueError):
        monkeypatch.setenv("TIDEVEC_LOG_LEVEL", "loud")
        config.log_level({})
    m = metrics.Metrics()
    m.add("rows", 3)
    with m.timed("step"):
        pass
    m.dump_tsv(str(tmp_path / "m.tsv"))
    assert (tmp_path / "m.tsv").read_text().startswith("metric\tvalue\nrows\t3\nstep_ms\t")
    df, seen = metrics.observed(spark.range(5).toDF("x"))
    df.collect()
    assert seen.get["rows"] == 5
    metrics.append_report(spark, str(tmp_path / "report"), method="ivf", ms=1.5)
    metrics.append_report(spark, str(tmp_path / "report"), method="bf", ms=2.5)
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "report")).count() == 2


def test_memory_of_a_stream_window_is_that_of_its_numbers():
    """100,000 rows of a key, two of them null: windows of all of them at once took 69 MB."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    state = SimpleNamespace(exists=lambda: False, get=lambda: iter(()), update=lambda x: None, put=lambda x: None)
    order = np.random.default_rng(1).permutation(100_000)
    frames = (pd.DataFrame({"key": 1, "uid": order[i : i + 10_000], "ts": np.where(order[i : i + 10_000] < 2, np.nan, order[i : i + 10_000]), "vec": [np.ones(1)] * 10_000}) for i in range(0, 100_000, 10_000))
    window = streaming._CountWindow(4, 2, "sliding")
    window.seen, window.held = state, state
    tracemalloc.start()
    seen, n = [], 0
    for frame in window.handleInputRows((1,), frames, None):
        n += len(frame)
        seen = [*seen, *frame["uid"].tolist()][-4:]
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert n == 4 * 49_999 and seen == [99_998, 99_999, 0, 1] and peak < 40

import random

import corpus_pipeline
from pyspark.sql import functions as F

from tidevec.llm import decontaminate, langid, lines


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(1)
    words = ["the", "of", "and", "that", "with"] + ["".join(rng.choice("aeiourstnl") for _ in range(6)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id = 0").first()["text"]
    base = text(300)
    near = base.split()
    near[100] = "changed"
    planted = [(10**6, base), (10**6 + 1, base), (10**6 + 2, " ".join(near)), (10**6 + 3, text(50) + " " + item + " " + text(50)), (10**6 + 4, text(200)), (10**6 + 5, "%%% 123"), (10**6 + 6, None)]
    extra = spark.createDataFrame(planted, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    now = docs.unionByName(extra)
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        if name != "best_fit_packing":
            assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        results[name] = {r.doc_id for r in now.select("doc_id").collect()}
    new = {k: {i - 10**6 for i in v if i >= 10**6} for k, v in results.items()}
    assert new["language_id"] == new["line_dedup"] == {0, 1, 2, 3, 4}
    # the copy lost its only line, and the near copy is one of the first
    assert {0, 3, 4} <= new["near_dedup"] and 2 not in new["near_dedup"]
    assert 3 not in new["decontamination"] and {0, 4} <= new["decontamination"] == new["best_fit_packing"]
    left = spark.read.parquet(str(tmp_path / "decontamination"))
    assert decontaminate.overlaps(left, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert left.where("n_chars <> length(text)").count() == 0
    assert lines.removed(spark.read.parquet(str(tmp_path / "line_dedup"))).count() == 0
    packed = spark.read.parquet(str(tmp_path / "best_fit_packing"))
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).where("n <> m or n > 4096").count() == 0


def test_pipeline_runs_from_entry(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"](spark, "/root/testdata/sf0.001").count() > 100


def test_stages_on_edge_cases(spark):
    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, id int, gone string, _id int, node int, t int, first int, n_lines int"
    row = lambda i, t, lang="en": (i, t, lang, None, None, 1, "x", 2, 3, 4, 5, 6)
    some = spark.createDataFrame([row(1, None), row(None, "a few plain words of text, and some more of them"), row(2, ""), row(2, ""), row(3, "a few plain words of text, and some more of them", None), row(4, "x" * 100_000)], schema)
    for docs in (some, some.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.collect()
            if name != "best_fit_packing":
                assert out.columns == docs.columns
            if not docs.isEmpty() and name == "line_dedup":
                assert sorted((r.text or "")[:10] for r in rows) == ["", "", "", "", "a few plai", "x" * 10]
            if not docs.isEmpty() and name == "near_dedup":
                # the empty ones and the null one are a group, and so are the equal texts, of which the null id comes first
                assert sorted((str(r.doc_id), (r.text or "")[:3]) for r in rows) == [("1", ""), ("4", "xxx"), ("None", "a f")]


def test_the_driver_gets_no_texts_to_fit_on(spark, monkeypatch):
    def none(df):
        raise AssertionError("rows go through the driver")

    monkeypatch.setattr(type(spark.range(0)), "toArrow", none)
    rows = [(i, f"{'the of and to in' if i % 2 else 'der die und das ist'} word{i}", "en" if i % 2 else "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    assert sorted(set(model.languages)) == ["de", "en"] and model.predict([rows[3][1], rows[4][1]])[0][0] == "en"
    assert not langid.train(docs.where("false"), F.lit(True)).languages


def test_lines_in_shuffled_tables(spark, monkeypatch):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ") for _ in range(40)).strip() + " is a line" for _ in range(30)]
    rows = [(i, "\n".join([rng.choice(base), rng.choice(base[:2]), rng.choice(base) + "x", f"a row {i:03d} by itself, {i:03d}"])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda: sorted(map(tuple, lines.dedup(docs).collect()))
    whole = found()
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 3)
    assert found() == whole and sum(r[3] for r in whole) > 100

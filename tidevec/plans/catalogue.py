"""Queries over the driver tables, one or more for every operator, and the equivalent SQL.

E is ``embeddings`` as records (uid = ts = vec_id); V is ``events`` as records of
one-dimensional vectors. Numbers that are sums of doubles are rounded to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidevec.functions import vectors as v
from tidevec.operators import aggregate, index, join, topk, windows
from tidevec.schema import from_embeddings, from_events, micros
from tidevec.session import table
from tidevec.streaming import operators as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BAND = 50  # half width of the join's time band, in rows of E
THRESHOLD = 0.88


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def E(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_embeddings(table(spark, sf_dir, "embeddings"))


def V(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


_E = "e AS (SELECT vec_id AS uid, vec_id AS ts, embedding::DOUBLE[] AS vec FROM embeddings)"
_V = "e AS (SELECT event_id AS uid, epoch_ms(ts) AS ts, event_type, value FROM events)"


def _l2(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


# filters and maps


@query(f"WITH {_E} SELECT uid FROM e WHERE uid % 2 = 0")
def filter_uid_mod(spark, sf):
    return E(spark, sf).where("uid % 2 = 0").select("uid")


@query(f"WITH {_E} SELECT uid, round(vec[1], 6) AS x0 FROM e WHERE vec[1] > 0.05")
def filter_first_elem_gt(spark, sf):
    x0 = F.col("vec")[0].cast("double")
    return E(spark, sf).where(x0 > 0.05).select("uid", F.round(x0, 6).alias("x0"))


@query(f"WITH {_E} SELECT uid * 10 + 1000 AS uid, ts FROM e")
def map_uid_affine(spark, sf):
    return E(spark, sf).select((F.col("uid") * 10 + 1000).alias("uid"), "ts")


@query(f"WITH {_E} SELECT uid * 2 AS uid FROM (SELECT uid + 1000 AS uid FROM e WHERE uid % 3 = 0) WHERE uid < 1050")
def multi_stage_filter_map(spark, sf):
    first = E(spark, sf).where("uid % 3 = 0").withColumn("uid", F.col("uid") + 1000)
    return first.where("uid < 1050").select((F.col("uid") * 2).alias("uid"))


@query(f"WITH {_E} SELECT uid, count(*) FILTER (x > 0.1) AS n FROM (SELECT uid, unnest(vec) AS x FROM e) GROUP BY uid")
def filter_list_elements(spark, sf):
    kept = F.filter("vec", lambda x: x.cast("double") > 0.1)
    return E(spark, sf).select("uid", F.size(kept).cast("bigint").alias("n"))


@query(f"WITH {_E} SELECT uid, round(list_sum(list_transform(vec, lambda x: x * 2 + 1)), 6) AS s FROM e")
def map_list_elements(spark, sf):
    mapped = F.transform("vec", lambda x: x.cast("double") * 2 + 1)
    return E(spark, sf).select("uid", F.round(F.aggregate(mapped, F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@query(f"WITH {_E} SELECT uid, uid % 4 AS slot FROM e")
def fan_out_hash(spark, sf):
    from tidevec.sources.simple import fan_out

    out = [d.select("uid", F.lit(i).cast("bigint").alias("slot")) for i, d in enumerate(fan_out(E(spark, sf), "hash"))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


# vector functions: every row with its successor


def _pairs(spark, sf):
    e = E(spark, sf)
    a = e.select(F.col("uid").alias("l"), F.col("vec").alias("a"))
    return a.join(e.select((F.col("uid") - 1).alias("l"), F.col("uid").alias("r"), F.col("vec").alias("b")), "l")


def _vec(name: str, value, sql: str) -> None:
    def run(spark, sf):
        return _pairs(spark, sf).select("l", "r", F.round(value(F.col("a"), F.col("b")), 6).alias("x"))

    QUERIES[name] = run
    ORACLES[name] = f"WITH {_E} SELECT a.uid AS l, b.uid AS r, round({sql}, 6) AS x FROM e a JOIN e b ON b.uid = a.uid + 1"


_vec("vec_l2", v.l2, _l2("a.vec", "b.vec"))
_vec("vec_l2_sq", v.l2_sq, f"pow({_l2('a.vec', 'b.vec')}, 2)")
_vec("vec_similarity", v.similarity, f"exp(-0.1 * {_l2('a.vec', 'b.vec')})")
_vec("vec_dot", v.dot, _dot("a.vec", "b.vec"))
_vec("vec_cosine", v.cosine, f"{_dot('a.vec', 'b.vec')} / (sqrt({_dot('a.vec', 'a.vec')}) * sqrt({_dot('b.vec', 'b.vec')}))")
_vec("vec_mean2_checksum", lambda a, b: v.dot(v.mean2(a, b), v.mean2(a, b)), "list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: ((z[1] + z[2]) / 2) * ((z[1] + z[2]) / 2)))")


@query(f"WITH {_E} SELECT uid, round({_dot('vec', 'vec')}, 6) AS x FROM e")
def vec_sq_norm(spark, sf):
    return E(spark, sf).select("uid", F.round(v.sq_norm(F.col("vec")), 6).alias("x"))


@query(f"WITH {_E}, n AS (SELECT uid, list_transform(vec, lambda x: x * 3) AS w FROM e) SELECT uid, round(w[1] / sqrt({_dot('w', 'w')}), 6) AS x FROM n")
def vec_normalize_check(spark, sf):
    scaled = F.transform("vec", lambda x: x.cast("double") * 3)
    return E(spark, sf).withColumn("w", scaled).select("uid", F.round(v.normalize(F.col("w"))[0], 6).alias("x"))


@query(f"WITH {_E} SELECT a.uid AS l, b.uid AS r, a.vec = b.vec AS same FROM e a JOIN e b ON b.uid = a.uid + 1")
def vec_equal(spark, sf):
    return _pairs(spark, sf).select("l", "r", v.equal(F.col("a"), F.col("b")).alias("same"))


@query(f"WITH {_E} SELECT a.uid AS l, CAST(len(list_concat(a.vec, b.vec)) AS BIGINT) AS n, round(list_concat(a.vec, b.vec)[len(a.vec) + 1], 6) AS x FROM e a JOIN e b ON b.uid = a.uid + 1")
def vec_concat_dim(spark, sf):
    both = v.concat(F.col("a"), F.col("b"))
    return _pairs(spark, sf).select("l", F.size(both).cast("bigint").alias("n"), F.round(F.element_at(both, F.size("a") + 1).cast("double"), 6).alias("x"))


@query(f"WITH {_E} SELECT a.uid * 1000000 + b.uid AS uid, greatest(a.ts, b.ts) AS ts, a.uid AS l, b.uid AS r FROM e a JOIN e b ON b.uid = a.uid + 1")
def combined_uid(spark, sf):
    made = _pairs(spark, sf).select(v.combined_uid(F.col("l"), F.col("r")).alias("uid"), F.greatest("l", "r").alias("ts"))
    left, right = v.split_uid(F.col("uid"))
    return made.select("uid", "ts", left.alias("l"), right.alias("r"))


# top-k: every row whose id is divisible by 50 is a query, against all rows


def _queries(e: DataFrame) -> DataFrame:
    return e.where("uid % 50 = 0")


_NEAR = f"""near AS (SELECT q.uid AS qid, x.uid AS uid, {_l2("q.vec", "x.vec")} AS d FROM e q, e x WHERE q.uid % 50 = 0)"""


def _top(k: int, where: str = "true") -> str:
    return f"""SELECT qid, rank, uid, round(d, 6) AS dist FROM (
  SELECT qid, uid, d, row_number() OVER (PARTITION BY qid ORDER BY d, uid) AS rank FROM near WHERE {where}) WHERE rank <= {k}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("dist", F.round("dist", 6))


@query(f"WITH {_E}, {_NEAR} {_top(10)}")
def topk_exact(spark, sf):
    e = E(spark, sf)
    return _rounded(topk.topk(_queries(e), e, 10))


@query(f"WITH {_E}, {_NEAR} {_top(5, 'qid % 100 = 0')}")
def topk_filtered_queries(spark, sf):
    e = E(spark, sf)
    return _rounded(topk.topk(_queries(e).where("uid % 100 = 0"), e, 5))


@query(f"WITH {_E}, {_NEAR} {_top(10)}")
def vectraflow_topk(spark, sf):
    registry = index.Registry(spark)
    e = E(spark, sf)
    number = registry.create_index("base", "vectraflow", 64)
    registry.insert(number, e)
    return _rounded(registry.query(number, _queries(e), 10))


@query(f"WITH {_E}, near AS (SELECT x.uid, {_l2('q.vec', 'x.vec')} AS d FROM e q, e x WHERE q.uid = 0) SELECT uid, round(d, 6) AS dist FROM near ORDER BY d, uid LIMIT 20")
def storage_topk(spark, sf):
    e = E(spark, sf)
    target = e.where("uid = 0").first()["vec"]
    return topk.nearest_to(e, target, 20).withColumn("dist", F.round("dist", 6))


@query(f"WITH {_E}, {_NEAR} SELECT qid, uid, round(exp(-0.1 * d), 6) AS sim FROM near WHERE exp(-0.1 * d) >= {THRESHOLD}")
def range_query(spark, sf):
    e = E(spark, sf)
    return topk.within(_queries(e), e, THRESHOLD).withColumn("sim", F.round("sim", 6))


# indexes


@query(f"WITH {_E} SELECT uid AS ordinal, uid, round(vec[1], 6) AS x0 FROM e UNION ALL SELECT uid + 1000000, uid, round(vec[1], 6) FROM e WHERE uid % 50 = 0")
def point_get(spark, sf):
    e = E(spark, sf)
    registry = index.Registry(spark)
    number = registry.create_index("base")
    registry.insert(number, e)
    asked = e.select(F.col("uid").alias("ordinal"), "uid")
    again = e.where("uid % 50 = 0").select((F.col("uid") + 1000000).alias("ordinal"), "uid")
    missing = e.select((F.col("uid") + 2000000).alias("ordinal"), (-1 - F.col("uid")).alias("uid"))
    found = registry[number].get(asked.unionByName(again).unionByName(missing))
    return found.select("ordinal", "uid", F.round(F.col("vec")[0], 6).alias("x0"))


@query(f"WITH {_E} SELECT uid, ts FROM e UNION ALL SELECT uid + 1000000, ts FROM e WHERE uid % 2 = 0")
def index_insert_dedup(spark, sf):
    e = E(spark, sf)
    registry = index.Registry(spark)
    number = registry.create_index("base")
    registry.insert(number, e)
    # half of these have uids that are taken: the rows already there stay
    registry.insert(number, e.withColumn("ts", F.col("ts") + 7))
    registry.insert(number, e.where("uid % 2 = 0").withColumn("uid", F.col("uid") + 1000000))
    return registry[number].rows.select("uid", "ts")


@query(f"WITH {_E}, {_NEAR} {_top(10, 'uid % 3 <> 0')}")
def index_erase_topk(spark, sf):
    e = E(spark, sf)
    registry = index.Registry(spark)
    number = registry.create_index("base", "bruteforce", 64)
    registry.insert(number, e)
    registry.erase(number, e.where("uid % 3 = 0").select("uid"))
    return _rounded(registry.query(number, _queries(e), 10))


@query(f"WITH {_E}, {_NEAR} {_top(10)}")
def ivf_topk_full_probe(spark, sf):
    e = E(spark, sf)
    registry = index.Registry(spark)
    number = registry.create_index("base", "ivf", 64, nlist=8, nprobe=8)
    registry.insert(number, e)
    return _rounded(registry.query(number, _queries(e), 10))


@query(None)
def ivf_topk_recall(spark, sf):
    e = E(spark, sf)
    registry = index.Registry(spark)
    number = registry.create_index("base", "ivf", 64, nlist=16, nprobe=12)
    registry.insert(number, e)
    return topk.recall(registry.query(number, _queries(e), 10), topk.topk(_queries(e), e, 10), 10)


@query(f"WITH {_E}, {_NEAR} {_top(10)}")
def hnsw_topk(spark, sf):
    e = E(spark, sf)
    registry = index.Registry(spark)
    number = registry.create_index("base", "hnsw", 64)
    registry.insert(number, e)
    return _rounded(registry.query(number, _queries(e), 10))


# the similarity join: even rows against odd ones within the band


def _halves(spark, sf):
    e = E(spark, sf)
    return e.where("uid % 2 = 0"), e.where("uid % 2 = 1")


_PAIRS = f"""p AS (SELECT a.uid AS l, b.uid AS r, greatest(a.ts, b.ts) AS ts, abs(a.ts - b.ts) AS dt, a.vec AS lv, b.vec AS rv, exp(-0.1 * {_l2("a.vec", "b.vec")}) AS sim
  FROM e a JOIN e b ON abs(a.ts - b.ts) <= {BAND} WHERE a.uid % 2 = 0 AND b.uid % 2 = 1)"""
_JOINED = f"WITH {_E}, {_PAIRS} SELECT l, r, ts, round(sim, 6) AS sim FROM p WHERE sim >= {THRESHOLD}"


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("sim", F.round("sim", 6))


@query(_JOINED)
def sim_join_band(spark, sf):
    return _joined(join.similarity_join(*_halves(spark, sf), BAND, THRESHOLD, "bruteforce_eager"))


@query(_JOINED)
def sim_join_lazy(spark, sf):
    return _joined(join.similarity_join(*_halves(spark, sf), BAND, THRESHOLD, "bruteforce_lazy"))


@query(f"WITH {_E}, {_PAIRS} SELECT l, r, ts, round(sim, 6) AS sim FROM p WHERE sim >= {THRESHOLD} AND dt < {BAND}")
def sim_join_half_open(spark, sf):
    return _joined(join.similarity_join(*_halves(spark, sf), BAND, THRESHOLD, boundary="half_open"))


@query(f"WITH {_E} SELECT a.uid AS l, b.uid + 500000 AS r, greatest(a.ts, b.ts) AS ts, round(exp(-0.1 * {_l2('a.vec', 'b.vec')}), 6) AS sim FROM e a JOIN e b ON abs(a.ts - b.ts) <= {BAND} WHERE exp(-0.1 * {_l2('a.vec', 'b.vec')}) >= 0.9")
def sim_join_self_offset(spark, sf):
    e = E(spark, sf)
    return _joined(join.similarity_join(e, e.withColumn("uid", F.col("uid") + 500000), BAND, 0.9))


@query(f"WITH {_E}, {_PAIRS} SELECT l * 1000000 + r + 100000 AS uid, ts, round(list_sum(list_transform(list_zip(lv, rv), lambda z: (z[1] + z[2]) / 2)), 6) AS total FROM p WHERE sim >= {THRESHOLD} AND l % 3 = 0 AND r % 3 <> 0")
def sim_join_prefiltered_postmap(spark, sf):
    left, right = _halves(spark, sf)
    mean = v.mean2(F.col("l.vec"), F.col("r.vec"))
    made = join.similarity_join(
        left.where("uid % 3 = 0"), right.where("uid % 3 <> 0"), BAND, THRESHOLD,
        project=[v.combined_uid(F.col("l.uid"), F.col("r.uid")).alias("uid"), F.greatest("l.ts", "r.ts").alias("ts"), mean.alias("vec")],
    )
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return made.select((F.col("uid") + 100000).alias("uid"), "ts", F.round(total, 6).alias("total"))


@query(f"WITH {_E}, {_PAIRS} SELECT l, r, ts, round(sim, 6) AS sim FROM p WHERE sim >= 0.85 AND {_dot('lv', 'rv')} > 0.1")
def sim_join_residual_dot(spark, sf):
    return _joined(join.similarity_join(*_halves(spark, sf), BAND, 0.85, residual=v.dot(F.col("l.vec"), F.col("r.vec")) > 0.1).select("l", "r", "ts", "sim"))


@query(_JOINED)
def ivf_join_full_probe(spark, sf):
    return _joined(join.similarity_join(*_halves(spark, sf), BAND, THRESHOLD, "ivf_eager", nlist=8, nprobe=8))


@query(None)
def ivf_join_quality(spark, sf):
    from tidevec.plans.metrics import quality

    left, right = _halves(spark, sf)
    return quality(join.similarity_join(left, right, BAND, THRESHOLD, "ivf_lazy", nlist=8, nprobe=7), join.similarity_join(left, right, BAND, THRESHOLD), ["l", "r"])


@query(None)
def lsh_join_quality(spark, sf):
    from tidevec.plans.metrics import quality

    left, right = _halves(spark, sf)
    return quality(join.similarity_join(left, right, BAND, THRESHOLD, "lsh_lazy", bucket_length=4.0, tables=8), join.similarity_join(left, right, BAND, THRESHOLD), ["l", "r"])


@query(f"WITH {_V} SELECT c.uid AS l, w.uid AS r FROM e c JOIN e w ON c.ts - w.ts BETWEEN -3600000 AND 3600000 AND abs(c.value - w.value) <= 5 WHERE c.event_type = 'click' AND w.event_type = 'view'")
def events_band_join(spark, sf):
    e = table(spark, sf, "events")
    left, right = (from_events(e.where(F.col("event_type") == kind), nameless=True) for kind in ("click", "view"))
    close = F.abs(F.col("l.vec")[0] - F.col("r.vec")[0]) <= 5
    return join.band_join(left, right, 3_600_000, close, [F.col("l.uid").alias("l"), F.col("r.uid").alias("r")])


# count windows

SIZE, SLIDING, SLIDE = 30, 20, 7
_POS = "o AS (SELECT *, row_number() OVER (ORDER BY ts, uid) - 1 AS pos, count(*) OVER () AS total FROM e)"
_TUMBLING = f"w AS (SELECT pos // {SIZE} AS wid, pos % {SIZE} AS slot, * EXCLUDE (pos, total) FROM o WHERE pos // {SIZE} < total // {SIZE})"


def _sliding_sql(slide: int) -> str:
    return f"""w AS (SELECT i AS wid, o.pos - i * {slide} AS slot, o.* EXCLUDE (pos, total)
  FROM (SELECT unnest(range((SELECT (count(*) - {SLIDING}) // {slide} + 1 FROM e))) AS i) g JOIN o ON o.pos BETWEEN i * {slide} AND i * {slide} + {SLIDING - 1})"""


@query(f"WITH {_E}, {_POS}, {_TUMBLING} SELECT wid, slot, uid FROM w")
def tumbling_count_members(spark, sf):
    return windows.tumbling(E(spark, sf), SIZE).select("wid", F.col("slot").cast("bigint").alias("slot"), "uid")


@query(f"WITH {_V}, {_POS} SELECT pos // 400 AS wid, count(*) AS n FROM o WHERE pos // 400 < total // 400 GROUP BY ALL")
def tumbling_drop_partial(spark, sf):
    return aggregate.aggregate(windows.tumbling(V(spark, sf), 400), "count")


@query(f"WITH {_E}, {_POS}, {_sliding_sql(1)} SELECT wid, slot, uid FROM w")
def sliding_count_members(spark, sf):
    return windows.sliding(E(spark, sf), SLIDING).select("wid", F.col("slot").cast("bigint").alias("slot"), "uid")


@query(f"WITH {_E}, {_POS}, {_sliding_sql(SLIDE)} SELECT wid, slot, uid FROM w")
def sliding_count_slide(spark, sf):
    return windows.sliding(E(spark, sf), SLIDING, SLIDE).select("wid", F.col("slot").cast("bigint").alias("slot"), "uid")


def _elements_sql(window: str, fold: str) -> str:
    return f"WITH {_E}, {_POS}, {window} SELECT wid, pos, round({fold}(x), 6) AS value FROM (SELECT wid, unnest(range(len(vec))) AS pos, unnest(vec) AS x FROM w) GROUP BY wid, pos"


@query(_elements_sql(_TUMBLING, "avg"))
def tumbling_avg_vec(spark, sf):
    return aggregate.elements(windows.tumbling(E(spark, sf), SIZE), "avg").withColumn("value", F.round("value", 6))


@query(_elements_sql(_TUMBLING, "sum"))
def tumbling_sum_vec(spark, sf):
    return aggregate.elements(windows.tumbling(E(spark, sf), SIZE), "sum").withColumn("value", F.round("value", 6))


@query(_elements_sql(_sliding_sql(SLIDE), "avg"))
def sliding_avg_vec(spark, sf):
    return aggregate.elements(windows.sliding(E(spark, sf), SLIDING, SLIDE), "avg").withColumn("value", F.round("value", 6))


@query(f"WITH {_E}, {_POS}, {_TUMBLING} SELECT wid, uid, ts, round(vec[1], 6) AS x0 FROM w WHERE slot = 0")
def tumbling_first(spark, sf):
    return aggregate.aggregate(windows.tumbling(E(spark, sf), SIZE), "first").select("wid", "uid", "ts", F.round(F.col("vec")[0].cast("double"), 6).alias("x0"))


@query(f"WITH {_E}, {_POS}, {_TUMBLING}, f AS (SELECT wid, uid, ts FROM w WHERE slot = 0), a AS (SELECT wid, avg(vec[1]) AS x0, avg(vec[64]) AS x63 FROM w GROUP BY wid) SELECT wid, uid, ts, round(x0, 6) AS x0, round(x63, 6) AS x63 FROM f JOIN a USING (wid)")
def tumbling_avg_record(spark, sf):
    got = aggregate.aggregate(windows.tumbling(E(spark, sf), SIZE), "avg")
    return got.select("wid", "uid", "ts", F.round(F.col("vec")[0], 6).alias("x0"), F.round(F.col("vec")[63], 6).alias("x63"))


@query(f"WITH {_V}, {_POS} SELECT pos // 100 AS wid, 0::BIGINT AS pos, round(avg(value), 6) AS value FROM o WHERE pos // 100 < total // 100 GROUP BY ALL")
def events_tumbling_avg(spark, sf):
    return aggregate.elements(windows.tumbling(V(spark, sf), 100), "avg").withColumn("value", F.round("value", 6))


@query(f"WITH {_V}, {_POS} SELECT pos // 50 AS part, round(avg(value), 6) AS mean, count(value) AS n FROM o GROUP BY ALL")
def events_running_mean(spark, sf):
    from tidevec.operators.order import positions

    rows = positions(V(spark, sf)).withColumn("x", F.col("vec")[0])
    return aggregate.running_mean(rows, "x", 50).withColumn("mean", F.round("mean", 6))


def _itopk_sql(window: str) -> str:
    return f"""WITH {_E}, {_POS}, {window}, q AS (SELECT vec AS qv FROM e WHERE uid = 0),
d AS (SELECT wid, uid, {_l2("vec", "qv")} AS d FROM w, q),
r AS (SELECT wid, uid, d, row_number() OVER (PARTITION BY wid ORDER BY d, uid) AS rank FROM d)
SELECT wid, rank, uid, round(d, 6) AS dist FROM r WHERE rank <= 5"""


def _itopk(spark, sf, rows):
    target = E(spark, sf).where("uid = 0").first()["vec"]
    return topk.itopk(rows, target, 5).withColumn("dist", F.round("dist", 6))


@query(_itopk_sql(_TUMBLING))
def itopk_tumbling(spark, sf):
    return _itopk(spark, sf, windows.tumbling(E(spark, sf), SIZE))


@query(_itopk_sql(_sliding_sql(1)))
def itopk_sliding(spark, sf):
    return _itopk(spark, sf, windows.sliding(E(spark, sf), SLIDING))


@query(_itopk_sql(_sliding_sql(1)).replace("SELECT wid, rank, uid, round(d, 6) AS dist FROM r WHERE rank <= 5", "SELECT uid, count(*) AS n FROM r WHERE rank <= 5 GROUP BY uid HAVING count(*) > 1"))
def itopk_dup_counts(spark, sf):
    return aggregate.duplicates(_itopk(spark, sf, windows.sliding(E(spark, sf), SLIDING)))


@query("SELECT user_id AS uid, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def group_count_dups(spark, sf):
    return aggregate.duplicates(table(spark, sf, "events").select(F.col("user_id").alias("uid")))


@query(f"WITH {_E} SELECT uid, row_number() OVER (ORDER BY ts DESC, uid DESC) - 1 AS pos FROM e")
def lifo_order(spark, sf):
    from tidevec.operators.order import positions

    return positions(E(spark, sf), descending=True).select("uid", "pos")


@query(f"WITH {_E} SELECT uid, printf('uid=%d ts=%d [%.6f, %.6f]', uid, ts, vec[1], vec[2]) AS line FROM e")
def render_record(spark, sf):
    return E(spark, sf).select("uid", v.render(F.col("uid"), F.col("ts"), F.slice("vec", 1, 2)).alias("line"))


# streams, run over what there is


def _stream(spark, sf, name):
    from tidevec.sources.simple import stream_parquet

    # a pattern, as the table may be a file or a folder
    return stream_parquet(spark, f"{sf}/{name}.parque[t]", table(spark, sf, name).schema)


@query(f"WITH {_E} SELECT uid * 10 AS uid, round(vec[1], 6) AS x0 FROM e WHERE uid % 2 = 0")
def stream_filter_map(spark, sf):
    e = from_embeddings(_stream(spark, sf, "embeddings"))
    return streaming.run_to_end(e.where("uid % 2 = 0").select((F.col("uid") * 10).alias("uid"), F.round(F.col("vec")[0].cast("double"), 6).alias("x0")))


@query(_JOINED)
def stream_join(spark, sf):
    left = from_embeddings(_stream(spark, sf, "embeddings")).where("uid % 2 = 0")
    right = from_embeddings(_stream(spark, sf, "embeddings")).where("uid % 2 = 1")
    return streaming.run_to_end(_joined(streaming.similarity_join(left, right, BAND, THRESHOLD)))


@query(f"WITH k AS (SELECT user_id % 16 AS key, event_id AS uid, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id % 16) AS total FROM events) SELECT key, pos // 25 AS wid, pos % 25 AS slot, uid FROM k WHERE pos // 25 < total // 25")
def stream_count_window(spark, sf):
    e = _stream(spark, sf, "events")
    e = e.select(F.col("event_id").alias("uid"), micros(e).alias("ts"), F.array(F.col("value")).alias("vec"), (F.col("user_id") % 16).alias("key"))
    return streaming.run_to_end(streaming.count_window(e, 25, key=F.col("key")).select("key", "wid", "slot", "uid"))


@query(f"WITH {_E}, {_NEAR} {_top(10)}")
def stream_topk(spark, sf):
    q = _queries(from_embeddings(_stream(spark, sf, "embeddings")))
    base = E(spark, sf)
    return streaming.run_to_end(q, lambda batch: _rounded(topk.topk(batch, base, 10)))


@query(f"WITH {_E}, {_NEAR} SELECT qid, uid, round(exp(-0.1 * d), 6) AS sim FROM near WHERE exp(-0.1 * d) >= 0.9")
def stream_range_probe(spark, sf):
    q = _queries(from_embeddings(_stream(spark, sf, "embeddings")))
    probe = streaming.range_probe_batch(E(spark, sf), 0.9)
    return streaming.run_to_end(q, lambda b: probe(b).withColumn("sim", F.round("sim", 6)))

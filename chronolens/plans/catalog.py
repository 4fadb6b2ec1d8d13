"""Queries over the driver's tables, one for each operator, with oracles.

A query is a function of (spark, sf_dir); ``query(sql)`` registers it with the
DuckDB SQL it must equal (None where SQL can't express it).  Floats are rounded
to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolens.functions import arrays
from chronolens.functions.plan import KERNELS, BankPlan, dilation_plan, feature_dim, kernels_df
from chronolens.operators import attribution as at
from chronolens.operators import channels as ch
from chronolens.operators import metrics, occlusion, ranking, saliency, sampling, selection, spectral
from chronolens.operators.attribution import Feature
from chronolens.sources import series as src

from . import sqltext as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Features of the queries that follow a few kernels over time.
CHOSEN = [
    Feature(0, "raw", 1, 0, 0.1, 1.0),
    Feature(4, "raw", 2, 20, 0.05, 0.8),
    Feature(8, "diff", 1, 41, 0.2, 0.6),
    Feature(12, "diff", 3, 60, -0.1, 0.5),
    Feature(16, "raw", 7, 83, 0.3, 0.3),
    Feature(20, "raw", 2, 45, 0.0, 0.25),
]
L = 64


def r6(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6) + F.lit(0.0)
    return out.alias(name) if name else out


def emb(spark, d):
    return src.embeddings(spark, d)


def preds(spark, d):
    t = spark.read.parquet(f"{d}/embeddings.parquet")
    pred = F.when(F.col("vec_id") % 3 == 0, ((F.col("vec_id") * 7 + F.col("label")) % 10).cast("int")).otherwise(F.col("label"))
    return t.select(F.col("vec_id").alias("id"), F.col("label").alias("y"), pred.alias("pred"))


def dim(spark, d=None):
    f = feature_dim(spark, BankPlan(64, 1000, 32))
    return f.withColumn("importance", ((F.col("feature_index").cast("long") * 7919) % 1009) / F.lit(1009.0))


# -- sources -----------------------------------------------------------------


@query(f"WITH {q.DAILY} SELECT id, y, CAST(len(x) AS INT) AS n, round(list_sum(x), 6) AS total, round(x[1], 6) AS first_day FROM daily")
def series_events_daily(spark, d):
    s = src.checked(src.events_daily(spark, d), src.EVENT_DAYS)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return s.select("id", "y", F.size("x").alias("n"), r6(total, "total"), r6(F.col("x")[0], "first_day"))


@query("""
WITH m AS (SELECT o_custkey AS id, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS t, sum(o_totalprice) AS v FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1, 2)
SELECT id, 80 AS n, round(sum(v), 4) AS total, CAST(count(*) AS BIGINT) AS active_months FROM m WHERE t BETWEEN 0 AND 79 GROUP BY 1""")
def series_orders_monthly(spark, d):
    s = src.orders_monthly(spark, d)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return s.select("id", F.size("x").alias("n"), F.round(total, 4).alias("total"), F.size(F.filter("x", lambda v: v != 0)).cast("long").alias("active_months"))


@query("""SELECT 'events' AS source, count(*) FILTER (t BETWEEN 0 AND 29) AS inside, count(*) FILTER (t NOT BETWEEN 0 AND 29) AS outside, count(*) FILTER (t IS NULL) AS undated
FROM (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t FROM events WHERE user_id IS NOT NULL)
UNION ALL SELECT 'orders', count(*) FILTER (t BETWEEN 0 AND 79), count(*) FILTER (t NOT BETWEEN 0 AND 79), count(*) FILTER (t IS NULL)
FROM (SELECT date_diff('month', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS t FROM orders WHERE o_custkey IS NOT NULL)""")
def calendar_coverage(spark, d):
    return src.coverage(spark, d)


@query(f"WITH {q.CHANNELS} SELECT id, CAST(channel AS INT) AS channel, CAST(len(x) AS INT) AS n, round(list_sum(x), 6) AS total FROM channels")
def channel_pivot(spark, d):
    s = src.events_channels(spark, d)
    return s.select("id", "channel", F.size("x").alias("n"), r6(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), "total"))


@query(f"WITH {q.EMBED}, d AS (SELECT id, {q.DIFF} AS dx FROM series) SELECT id, CAST(unnest(range(0, len(dx))) AS INT) AS t, round(unnest(dx), 6) + 0.0 AS v FROM d")
def first_diff(spark, d):
    return emb(spark, d).select("id", F.posexplode(arrays.diff(F.col("x"))).alias("t", "v")).select("id", "t", r6("v", "v"))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS y, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def label_map(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderstatus").alias("y"))
    return src.map_labels(t, "F").groupBy("y").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT label AS y FROM embeddings")
def distinct_classes(spark, d):
    return emb(spark, d).select("y").distinct()


# -- plan --------------------------------------------------------------------


@query(f"WITH {q.KERNEL_CTE} SELECT * FROM kernels")
def base_kernels(spark, d):
    return kernels_df(spark)


@query("SELECT CAST(i AS BIGINT) AS i, round(((i + 1) * ((1 + sqrt(5::DOUBLE)) / 2)) % 1, 9) AS q FROM range(0, 500) r(i)")
def quantile_seq(spark, d):
    return spark.range(500).select(F.col("id").alias("i"), F.round(((F.col("id") + 1) * ((1 + F.sqrt(F.lit(5.0))) / 2)) % 1, 9).alias("q"))


PLAN_LENGTHS = [16, 20, 21, 29, 30, 63, 64, 99, 100, 200, 500, 1024]


@query(f"""
WITH RECURSIVE len AS (SELECT unnest({PLAN_LENGTHS}) AS length),
base AS (SELECT length, 119 AS per, 16 AS asked, 119 / 16.0::DOUBLE AS share, greatest(log2((length - 1) / 8.0::DOUBLE), 0) AS e FROM len),
sized AS (SELECT *, least(asked, CAST(floor(e) AS INT) + 1) AS n FROM base),
steps AS (SELECT length, share, e, n, 0 AS i, CAST(floor(share) AS INT) AS b, CAST(floor(share) AS INT) AS used FROM sized
  UNION ALL SELECT length, share, e, n, i + 1, CAST(floor((i + 2) * share - used) AS INT), used + CAST(floor((i + 2) * share - used) AS INT) FROM steps WHERE i + 1 < n)
SELECT CAST(length AS INT) AS length, CAST(i AS INT) AS i, CAST(floor(pow(2, i * e / greatest(n - 1, 1))) AS INT) AS dilation, CAST(b AS INT) AS n_bias FROM steps""")
def dilation_plans(spark, d):
    rows = [(n, i, a, b) for n in PLAN_LENGTHS for i, (a, b) in enumerate(zip(*dilation_plan(n, 10000, 16)))]
    return spark.createDataFrame(rows, "length int, i int, dilation int, n_bias int")


@query(f"WITH {q.dim()}, {q.KERNEL_CTE} SELECT feature_index, representation, dilation, CAST(1 + 8 * dilation AS INT) AS receptive_field, kernel_index, i0, i1, i2, pooling_op, pooling_index FROM dim JOIN kernels USING (kernel_index)")
def feature_dimension(spark, d):
    return dim(spark).select("feature_index", "representation", "dilation", "receptive_field", "kernel_index", "i0", "i1", "i2", "pooling_op", "pooling_index")


@query(f"WITH {q.dim()} SELECT vec_id AS id, feature_index, representation, dilation, kernel_index, pooling_op FROM embeddings JOIN dim ON feature_index = vec_id * 37 % 2016")
def decode_features(spark, d):
    long = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), (F.col("vec_id") * 37 % 2016).cast("int").alias("feature_index"))
    return long.join(F.broadcast(dim(spark)), "feature_index").select("id", "feature_index", "representation", "dilation", "kernel_index", "pooling_op")


# -- transform ---------------------------------------------------------------


ONE = Feature(0, "raw", 2, KERNELS.index((0, 4, 8)), 0.1)


@query(f"WITH {q.EMBED}, {q.act('series', [ONE], False)} SELECT id, CAST(t AS INT) AS t, round(c, 6) + 0.0 AS c FROM act")
def conv_single(spark, d):
    return at.activation_map(emb(spark, d), [ONE]).select("id", "t", r6("c", "c"))


@query(f"WITH {q.EMBED}, {q.act('series', CHOSEN[:3], False)} SELECT id, fi AS feature_index, CAST(t AS INT) AS t, round(c, 6) + 0.0 AS c, a AS act FROM act")
def activation_map(spark, d):
    return at.activation_map(emb(spark, d), CHOSEN[:3]).select("id", "feature_index", "t", r6("c", "c"), "act")


def _pool_sql(chosen, variant="core"):
    mid = {
        "core": "sum(a) / CAST(count(*) AS DOUBLE) AS ppv, coalesce(avg(CASE WHEN a = 1 THEN c - b END), 0) AS mpv, coalesce(avg(CASE WHEN a = 1 THEN t END), -1) AS mipv",
        "normalized": "sum(a) / CAST(count(*) AS DOUBLE) AS ppv, coalesce(avg(CASE WHEN a = 1 THEN c END), 0) AS mpv, coalesce(avg(CASE WHEN a = 1 THEN t END) / (count(*) - 1), 0) AS mipv",
    }[variant]
    run = "CAST(coalesce(max(n), 0) AS BIGINT)" if variant == "core" else "round(coalesce(max(n), 0) / any_value(z)::DOUBLE, 6)"
    return f"""WITH {q.EMBED}, {q.act('series', chosen, False)},
g AS (SELECT id, y, fi, t, a, t - row_number() OVER (PARTITION BY id, fi, a ORDER BY t) AS grp FROM act),
runs AS (SELECT id, fi, grp, count(*) AS n FROM g WHERE a = 1 GROUP BY 1, 2, 3),
longest AS (SELECT id, fi, max(n) AS n FROM runs GROUP BY 1, 2),
pools AS (SELECT id, y, fi, {mid}, count(*) AS z FROM act GROUP BY 1, 2, 3)
SELECT p.id, p.y, p.fi AS feature_index, round(any_value(ppv), 6) AS ppv, round(any_value(mpv), 6) + 0.0 AS mpv, round(any_value(mipv), 6) AS mipv, {run} AS lspv
FROM pools p LEFT JOIN longest l ON p.id = l.id AND p.fi = l.fi GROUP BY 1, 2, 3"""


@query(_pool_sql(CHOSEN))
def pool_features(spark, d):
    return at.pooled(emb(spark, d), CHOSEN).select("id", "y", "feature_index", r6("ppv", "ppv"), r6("mpv", "mpv"), r6("mipv", "mipv"), "lspv")


@query(_pool_sql(CHOSEN[2:4]))
def pool_diff_features(spark, d):
    return at.pooled(emb(spark, d), CHOSEN[2:4]).select("id", "y", "feature_index", r6("ppv", "ppv"), r6("mpv", "mpv"), r6("mipv", "mipv"), "lspv")


@query(_pool_sql(CHOSEN[:2], "normalized"))
def pool_normalized(spark, d):
    p = at.pooled(emb(spark, d), CHOSEN[:2], "normalized")
    return p.select("id", "y", "feature_index", *[r6(c, c) for c in ("ppv", "mpv", "mipv", "lspv")])


@query(f"""WITH {q.EMBED}, {q.KERNEL_CTE}, pts AS (SELECT id, unnest(x) AS v, unnest(range(0, len(x))) AS t FROM series),
shifted AS (SELECT p.id, p.t, k, coalesce(s.v, 0) AS v FROM pts p CROSS JOIN (SELECT unnest(range(0, 9)) AS k) LEFT JOIN pts s ON s.id = p.id AND s.t = p.t + (k - 4)),
nine AS (SELECT id, t, sum(v) AS s9, list(v ORDER BY k) AS taps FROM shifted GROUP BY 1, 2),
c AS (SELECT kernel_index, 3 * (taps[i0 + 1] + taps[i1 + 1] + taps[i2 + 1]) - s9 AS c FROM nine CROSS JOIN kernels)
SELECT kernel_index, CAST(count(*) AS BIGINT) AS n, round(avg(c), 5) + 0.0 AS mean_c, round(avg(abs(c)), 5) AS mean_abs_c FROM c GROUP BY 1""")
def conv_all_kernels(spark, d):
    """All 84 kernels at one dilation, in the bulk stage, summed per kernel."""
    import numpy as np
    import pyarrow as pa

    from chronolens.operators.transform import convolutions

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64)
            if len(x):
                rows = [(k, c.size, float(c.sum()), float(np.abs(c).sum())) for k, c in convolutions(x, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])], names=["kernel_index", "n", "s", "a"])

    parts = emb(spark, d).select("x").mapInArrow(run, "kernel_index int, n long, s double, a double")
    out = parts.groupBy("kernel_index").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("a").alias("a"))
    return out.select("kernel_index", "n", (F.round(F.col("s") / F.col("n"), 5) + 0.0).alias("mean_c"), F.round(F.col("a") / F.col("n"), 5).alias("mean_abs_c"))


BIAS_Q = [0.1, 0.25, 0.5, 0.618034, 0.9]


@query(f"""WITH {q.EMBED}, pool AS (SELECT * FROM series ORDER BY md5('0:pool:' || id), id LIMIT 100), {q.act('pool', CHOSEN[:3], False)},
o AS (SELECT fi, c, row_number() OVER (PARTITION BY fi ORDER BY c) - 1 AS r, count(*) OVER (PARTITION BY fi) AS m FROM act)
SELECT fi AS feature_index, q, round(c, 6) + 0.0 AS bias FROM o, (SELECT unnest({BIAS_Q}::DOUBLE[]) AS q) WHERE r = CAST(floor(q * (m - 1)) AS BIGINT)""")
def bias_orderstat(spark, d):
    """Order statistics of convolutions of a bounded pool of rows."""
    pool = emb(spark, d).orderBy(sampling.digest(0, "pool", "id"), "id").limit(100)
    c = at.activation_map(pool, CHOSEN[:3]).select("feature_index", "c")
    s = c.groupBy("feature_index").agg(F.sort_array(F.collect_list("c")).alias("s"))  # 100 series a kernel at most
    e = s.withColumn("q", F.explode(F.array(*[F.lit(v) for v in BIAS_Q])))
    return e.select("feature_index", "q", r6(F.get("s", F.floor(F.col("q") * (F.size("s") - 1)).cast("int")), "bias"))


@query(f"""WITH {q.EMBED}, c1 AS ({q.conv_rows('series', [CHOSEN[2]])}),
e AS (SELECT id, unnest(range(0, {L})) AS t, c FROM c1)
SELECT id, CAST(t AS INT) AS t, round(CASE WHEN t < len(c) THEN c[t + 1] + 0.25 ELSE 0 END, 6) + 0.0 AS activation FROM e""")
def kernel_activation(spark, d):
    a = at.activation_series(emb(spark, d), [CHOSEN[2]], L, 0.25)
    return a.select("id", "t", r6("activation", "activation"))


@query(f"""WITH {q.EMBED}, {q.act('series', [CHOSEN[i] for i in (0, 1, 4, 5)], False)}
SELECT id, round_even(256.0 / (8 * d), 1) AS frequency, CAST(t AS INT) AS t, round(avg(c), 6) + 0.0 AS activation FROM act GROUP BY 1, 2, 3""")
def activation_by_frequency(spark, d):
    a = at.activation_series(emb(spark, d), [CHOSEN[i] for i in (0, 1, 4, 5)], L)
    return at.by_frequency(a, 256.0).select("id", "frequency", "t", r6("activation", "activation"))


@query(f"""WITH {q.CHANNELS}, {q.act('channels', [CHOSEN[1]], False, 'id, channel, y')}
SELECT id, CAST(t AS INT) AS t, round(sum(c), 5) + 0.0 AS activation FROM act GROUP BY 1, 2""")
def channel_activation_sum(spark, d):
    a = at.activation_series(src.events_channels(spark, d), [CHOSEN[1]], src.EVENT_DAYS)
    return ch.channel_sum(a, "id").select("id", "t", (F.round("activation", 5) + 0.0).alias("activation"))


# -- filters, joins, sets ----------------------------------------------------


@query("SELECT label AS y, CAST(count(*) AS BIGINT) AS n FROM embeddings WHERE label IN (1, 4, 7) GROUP BY 1")
def class_filter(spark, d):
    return emb(spark, d).where(F.col("y").isin(1, 4, 7)).groupBy("y").agg(F.count("*").alias("n"))


@query(f"WITH {q.PRED} SELECT y, pred = y AS correct, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1, 2")
def outcome_split(spark, d):
    return preds(spark, d).groupBy("y", (F.col("pred") == F.col("y")).alias("correct")).agg(F.count("*").alias("n"))


MASK = [3, 5, 8, 13, 21, 34, 55]


@query(f"SELECT vec_id AS id, CAST(i AS INT) AS feature_index, round(CAST(embedding[i + 1] AS DOUBLE), 6) + 0.0 AS value FROM embeddings, (SELECT unnest({MASK}) AS i)")
def feature_projection(spark, d):
    """Columns of a feature vector by a mask, as a semi-join on the long view."""
    long = emb(spark, d).select("id", F.posexplode("x").alias("feature_index", "value"))
    mask = spark.createDataFrame([(i,) for i in MASK], "feature_index int")
    return long.join(F.broadcast(mask), "feature_index", "left_semi").select("id", "feature_index", r6("value", "value"))


@query(f"""WITH s AS (SELECT vec_id AS id, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(0, 64)) AS i FROM embeddings),
m AS (SELECT i, avg(v) AS mu, stddev_pop(v) AS sd FROM s GROUP BY 1)
SELECT id, round(sum(((CASE WHEN i IN {tuple(MASK)} THEN v ELSE 0 END) - mu) / sd), 5) + 0.0 AS score FROM s JOIN m USING (i) GROUP BY 1""")
def masked_scaled(spark, d):
    """Raw values outside of the mask become 0 before scaling."""
    long = emb(spark, d).select("id", F.posexplode("x").alias("i", "v"))
    m = long.groupBy("i").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    z = (F.when(F.col("i").isin(MASK), F.col("v")).otherwise(0.0) - F.col("mu")) / F.col("sd")
    return long.join(F.broadcast(m), "i").groupBy("id").agg((F.round(F.sum(z), 5) + 0.0).alias("score"))  # a row for each of 64 features


@query("SELECT vec_id AS id, label AS y FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 5")
def first_n_per_class(spark, d):
    return ranking.first_per_group(emb(spark, d).select("id", "y"), "y", 5)


@query(f"WITH {q.dim()} SELECT feature_index FROM dim WHERE feature_index IN (SELECT i * 301 FROM range(0, 12) r(i))")
def importance_gate(spark, d):
    """Mask entries beyond the bank are dropped."""
    mask = spark.range(12).select((F.col("id") * 301).cast("int").alias("feature_index"))
    return dim(spark).join(F.broadcast(mask), "feature_index", "left_semi").select("feature_index")


@query(f"WITH {q.dim()} SELECT representation, dilation, CAST(count(*) AS BIGINT) AS n FROM dim WHERE dilation <= 2 GROUP BY 1, 2")
def dilation_filter(spark, d):
    return dim(spark).where("dilation <= 2").groupBy("representation", "dilation").agg(F.count("*").alias("n"))


@query(f"WITH {q.PRED} SELECT y, pred = y AS correct, min(id) AS id FROM p GROUP BY 1, 2")
def trial_selection(spark, d):
    p = preds(spark, d).withColumn("correct", F.col("pred") == F.col("y"))
    w = Window.partitionBy("y", "correct").orderBy("id")
    return p.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("y", "correct", "id")


@query(f"WITH {q.dim()} SELECT feature_index, kernel_index FROM dim WHERE feature_index IN (SELECT i * 5 FROM range(0, 100) r(i))")
def semi_join_mask(spark, d):
    mask = spark.range(100).select((F.col("id") * 5).cast("int").alias("feature_index"))
    return dim(spark).join(F.broadcast(mask), "feature_index", "left_semi").select("feature_index", "kernel_index")


@query(f"WITH {q.dim()} SELECT k.kernel_index AS kernel_left_out, CAST(count(*) AS BIGINT) AS n, round(sum(importance), 6) AS total FROM (SELECT DISTINCT kernel_index FROM dim) k JOIN dim ON dim.kernel_index <> k.kernel_index GROUP BY 1")
def leave_group_out(spark, d):
    """Totals of all features but one kernel's: the whole less the group."""
    f = dim(spark)
    g = f.groupBy(F.col("kernel_index").alias("kernel_left_out")).agg(F.count("*").alias("g_n"), F.sum("importance").alias("g_s"))
    a = f.agg(F.count("*").alias("n"), F.sum("importance").alias("s"))
    return g.crossJoin(F.broadcast(a)).select("kernel_left_out", (F.col("n") - F.col("g_n")).alias("n"), r6(F.col("s") - F.col("g_s"), "total"))


@query(f"WITH {q.EMBED}, {q.class_mean('series')} SELECT a.y AS a, b.y AS b, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 6) AS distance FROM cm_avg a JOIN cm_avg b ON a.t = b.t AND a.y < b.y GROUP BY 1, 2")
def class_pair_distance(spark, d):
    m = at.class_means(emb(spark, d))
    a, b = m.select(F.col("y").alias("a"), "t", F.col("mean").alias("u")), m.select(F.col("y").alias("b"), "t", F.col("mean").alias("v"))
    return a.join(b, "t").where("a < b").groupBy("a", "b").agg(r6(F.sqrt(F.sum((F.col("u") - F.col("v")) * (F.col("u") - F.col("v")))), "distance"))


def _corr_sql():
    return f"""WITH s AS (SELECT vec_id AS id, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(0, 64)) AS i FROM embeddings),
m AS (SELECT * FROM s WHERE i IN {tuple(MASK)}),
pairs AS (SELECT a.i AS a, b.i AS b, corr(a.v, b.v) AS r FROM m a JOIN m b ON a.id = b.id AND a.i < b.i GROUP BY 1, 2)"""


def _masked_long(spark, d):
    return emb(spark, d).select("id", F.posexplode("x").alias("feature_index", "value")).where(F.col("feature_index").isin(MASK))


@query(_corr_sql() + " SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, round(r, 6) + 0.0 AS r FROM pairs")
def feature_correlation(spark, d):
    return at.correlations(_masked_long(spark, d)).select("a", "b", r6("r", "r"))


@query(_corr_sql() + " SELECT CAST(f AS INT) AS feature_index, CAST(sum(CASE WHEN abs(r) > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS degree FROM (SELECT a AS f, r FROM pairs UNION ALL SELECT b, r FROM pairs) GROUP BY 1")
def edge_degree(spark, d):
    return at.edges(at.correlations(_masked_long(spark, d)), 0.05)


@query("""WITH w AS (SELECT CAST(i * 5 AS INT) AS pos FROM range(0, 6) r(i)), t AS (SELECT unnest(range(0, 30)) AS t)
SELECT CAST(pos AS INT) AS pos, CAST(t AS INT) AS t FROM w JOIN t ON t >= pos AND t < pos + 5""")
def window_membership(spark, d):
    """Range join of windows and the timepoints they cover, as an explode."""
    w = spark.range(6).select((F.col("id") * 5).cast("int").alias("pos"))
    return w.select("pos", F.explode(F.sequence("pos", F.col("pos") + 4)).alias("t"))


@query("SELECT explainer, perturbation, round(f * 0.05, 2) AS fraction FROM (SELECT unnest(['a', 'b', 'c']) AS explainer), (SELECT unnest(['zero', 'mean', 'noise', 'inverse']) AS perturbation), (SELECT unnest(range(1, 11)) AS f)")
def explainer_grid(spark, d):
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "explainer string")
    p = spark.createDataFrame([(n,) for n in saliency.PERTURBATIONS], "perturbation string")
    return e.crossJoin(p).withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in saliency.FRACTIONS])))


FREQ = "f AS (SELECT vec_id AS id, abs(CAST(embedding[1] AS DOUBLE)) * 40 AS f, abs(CAST(embedding[2] AS DOUBLE)) AS a, vec_id % 7 AS trial FROM embeddings)"


def _modes(spark, d):
    x = emb(spark, d)
    return x.select("id", (F.abs(F.col("x")[0]) * 40).alias("frequency"), F.abs(F.col("x")[1]).alias("amplitude"), (F.col("id") % 7).alias("trial"))


@query(f"WITH {FREQ} SELECT id, CAST(ceil(f / 5.0) - 1 AS INT) AS bin FROM f WHERE f > 0 AND f <= 50")
def frequency_bins(spark, d):
    m = _modes(spark, d).withColumn("bin", spectral.frequency_bin(F.col("frequency"), 0, 50, 10))
    return m.where("bin IS NOT NULL").select("id", "bin")


@query(f"WITH {FREQ}, n AS (SELECT count(DISTINCT trial) AS n FROM f) SELECT CAST(ceil(f / 5.0) - 1 AS INT) AS bin, round(sum(a) / any_value(n.n), 6) AS amplitude FROM f, n WHERE f > 0 AND f <= 50 GROUP BY 1")
def marginal_spectrum(spark, d):
    return spectral.marginal_spectrum(_modes(spark, d), 0, 50, 10).select("bin", r6("amplitude", "amplitude"))


@query("SELECT * FROM (SELECT unnest(range(0, 400, 6)) AS feature_index) INTERSECT SELECT * FROM (SELECT unnest(range(0, 400, 10)) AS feature_index)")
def set_intersect(spark, d):
    return spark.range(0, 400, 6).select(F.col("id").alias("feature_index")).intersect(spark.range(0, 400, 10).select(F.col("id").alias("feature_index")))


@query(f"WITH {q.EMBED} SELECT id, CAST(len(x || {q.DIFF}) AS INT) AS n, round((x || {q.DIFF})[65], 6) + 0.0 AS first_diff_value FROM series")
def hstack_features(spark, d):
    both = F.concat(F.col("x"), arrays.diff(F.col("x")))
    return emb(spark, d).select("id", F.size(both).alias("n"), r6(both[64], "first_diff_value"))


@query(f"WITH {q.CHANNELS} SELECT id, CAST(sum(len(x)) AS INT) AS n, round(sum(list_sum(x)), 5) AS total FROM channels GROUP BY 1")
def channel_feature_concat(spark, d):
    f = ch.flatten(src.events_channels(spark, d))
    return f.select("id", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query("WITH c AS (SELECT CASE WHEN label < 3 THEN 0 ELSE 1 END AS y FROM embeddings), n AS (SELECT y, count(*) AS n FROM c GROUP BY 1) SELECT y, CAST((SELECT max(n) FROM n) AS BIGINT) AS n FROM n")
def oversample_counts(spark, d):
    from chronolens.operators.transform import oversample

    s = emb(spark, d).withColumn("y", F.when(F.col("y") < 3, 0).otherwise(1))
    return oversample(s).groupBy("y").agg(F.count("*").alias("n"))


# -- aggregates --------------------------------------------------------------


@query(f"WITH {q.EMBED}, {q.class_mean('series')} SELECT y, CAST(t AS INT) AS t, round(m, 6) + 0.0 AS mean FROM cm_avg")
def class_mean_series(spark, d):
    return at.class_means(emb(spark, d)).select("y", "t", r6("mean", "mean"))


RATE = f"WITH {q.EMBED}, {q.act('series', CHOSEN, True)}, rate AS (SELECT fi, imp, y, t, avg(a) AS r FROM act GROUP BY 1, 2, 3, 4), spread AS (SELECT fi, imp, t, max(r) - min(r) AS s FROM rate GROUP BY 1, 2, 3)"


@query(RATE + " SELECT fi AS feature_index, y, CAST(t AS INT) AS t, round(r, 6) AS rate FROM rate")
def activation_rate(spark, d):
    return at.activation_rate(emb(spark, d), CHOSEN).select("feature_index", "y", "t", r6("rate", "rate"))


@query(RATE + " SELECT fi AS feature_index, CAST(t AS INT) AS t, round(s, 6) AS diff FROM spread")
def differential_activation(spark, d):
    return at.differential(at.activation_rate(emb(spark, d), CHOSEN)).select("feature_index", "t", r6("diff", "diff"))


def _profile_sql(source: str) -> str:
    return f" SELECT CAST(g.t AS INT) AS t, round(coalesce(v, 0) / max(coalesce(v, 0)) OVER (), 6) AS importance FROM (SELECT unnest(range(0, {L})) AS t) g LEFT JOIN ({source}) z ON g.t = z.t"


@query(RATE + _profile_sql("SELECT t, sum(imp * s) AS v FROM spread GROUP BY 1"))
def temporal_importance(spark, d):
    return at.temporal_importance(emb(spark, d), CHOSEN, L).select("t", r6("importance", "importance"))


@query(RATE + " SELECT y, CAST(rate.t AS INT) AS t, round(sum(rate.imp * r * s), 6) AS importance FROM rate JOIN spread ON rate.fi = spread.fi AND rate.t = spread.t GROUP BY 1, 2")
def class_temporal_importance(spark, d):
    return at.class_temporal_importance(emb(spark, d), CHOSEN).select("y", "t", r6("importance", "importance"))


@query(RATE + _profile_sql("SELECT t, sum(imp) AS v FROM act WHERE a = 1 GROUP BY 1"))
def center_importance(spark, d):
    return at.center_importance(emb(spark, d), CHOSEN, L).select("t", r6("importance", "importance"))


@query(f"WITH {q.EMBED}, p AS (SELECT y, unnest(x) AS v, unnest(range(0, 64)) AS t FROM series) SELECT y, CAST(t AS INT) AS t, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v) / sqrt(count(*)), 6) AS sem FROM p GROUP BY 1, 2")
def mean_sem(spark, d):
    p = emb(spark, d).select("y", F.posexplode("x").alias("t", "v"))
    return p.groupBy("y", "t").agg(r6(F.avg("v"), "mean"), r6(F.stddev_pop("v") / F.sqrt(F.count("*")), "sem"))


CM = f"""WITH {q.PRED}, k AS (SELECT y AS c FROM p UNION SELECT pred FROM p), cm AS (SELECT a.c AS y, b.c AS pred, count(p.id) AS n FROM k a CROSS JOIN k b LEFT JOIN p ON p.y = a.c AND p.pred = b.c GROUP BY 1, 2)"""
MI = """mi AS (SELECT sum(CASE WHEN n > 0 THEN n / t * ln(n * t / (r * c)) / ln(2) ELSE 0 END) AS mi FROM
  (SELECT CAST(n AS DOUBLE) AS n, sum(n) OVER (PARTITION BY y)::DOUBLE AS r, sum(n) OVER (PARTITION BY pred)::DOUBLE AS c, sum(n) OVER ()::DOUBLE AS t FROM cm))"""


@query(CM + " SELECT y, pred, CAST(n AS BIGINT) AS n FROM cm")
def confusion_matrix(spark, d):
    return metrics.confusion(preds(spark, d))


@query(CM + f", {MI} SELECT round(mi, 6) AS mi FROM mi")
def mutual_information(spark, d):
    return metrics.mutual_information(metrics.confusion(preds(spark, d))).select(r6("mi", "mi"))


@query(CM + f""", {MI},
tr AS (SELECT y AS k, sum(n)::DOUBLE AS t, sum(CASE WHEN y = pred THEN n ELSE 0 END)::DOUBLE AS tp FROM cm GROUP BY 1), pr AS (SELECT pred AS k, sum(n)::DOUBLE AS q FROM cm GROUP BY 1),
e AS (SELECT k, t, tp, q, CASE WHEN t + q > 0 THEN 2 * tp / (t + q) ELSE 0 END AS f1 FROM tr JOIN pr USING (k))
SELECT round(sum(tp) / sum(t), 6) AS accuracy, round(avg(CASE WHEN t > 0 THEN tp / t END), 6) AS balanced_accuracy, round(avg(f1), 6) AS f1_macro, round(sum(f1 * t) / sum(t), 6) AS f1_weighted,
round((sum(tp) * sum(t) - sum(q * t)) / sqrt((sum(t) * sum(t) - sum(q * q)) * (sum(t) * sum(t) - sum(t * t))), 6) AS mcc, round(any_value(mi), 6) AS mutual_info FROM e, mi""")
def classification_metrics(spark, d):
    m = metrics.classification(preds(spark, d))
    return m.select(*[r6(c, c) for c in m.columns])


REG = "p AS (SELECT vec_id AS id, CAST(label AS DOUBLE) AS y, CAST(embedding[1] AS DOUBLE) + 0.5 * label AS pred FROM embeddings)"


@query(f"""WITH {REG} SELECT round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) AS r2, round(avg((y - pred) * (y - pred)), 6) AS mse, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse,
round(avg(abs(y - pred)), 6) AS mae, round(1 - var_pop(y - pred) / var_pop(y), 6) AS explained_variance, round(corr(y, pred), 6) AS pearson_r FROM p""")
def regression_metrics(spark, d):
    p = emb(spark, d).select("id", F.col("y").cast("double").alias("y"), (F.col("x")[0] + 0.5 * F.col("y")).alias("pred"))
    m = metrics.regression(p)
    return m.select(*[r6(c, c) for c in m.columns])


@query(f"""WITH {q.DAILY}, {q.act('daily', CHOSEN[:3], True)} SELECT fi AS feature_index, CAST(t AS INT) AS t,
round(CASE WHEN count(*) < 3 OR stddev_pop(c) = 0 OR stddev_pop(y) = 0 THEN 0 ELSE corr(c, y) END, 6) + 0.0 AS r FROM act GROUP BY 1, 2""")
def corr_by_time(spark, d):
    return at.correlation_by_time(src.events_daily(spark, d), CHOSEN[:3]).select("feature_index", "t", r6("r", "r"))


@query(f"""WITH {q.DAILY}, {q.act('daily', CHOSEN[:3], True)}, c AS (SELECT t, imp, CASE WHEN count(*) < 3 OR stddev_pop(c) = 0 OR stddev_pop(y) = 0 THEN 0 ELSE corr(c, y) END AS r FROM act GROUP BY fi, imp, t),
z AS (SELECT t, sum(imp * abs(r)) AS v FROM c GROUP BY 1) SELECT CAST(g.t AS INT) AS t, round(coalesce(v, 0) / max(coalesce(v, 0)) OVER (), 6) AS importance FROM (SELECT unnest(range(0, 30)) AS t) g LEFT JOIN z ON g.t = z.t""")
def regression_temporal_importance(spark, d):
    return at.regression_importance(src.events_daily(spark, d), CHOSEN[:3], src.EVENT_DAYS).select("t", r6("importance", "importance"))


@query("""WITH v AS (SELECT label AS y, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings), b AS (SELECT min(v) AS lo, (max(v) - min(v)) / 30 AS w FROM v),
c AS (SELECT y, CAST(least(29, floor((v - lo) / w)) AS INT) AS bin, count(*) AS n, any_value(w) AS w FROM v, b GROUP BY 1, 2)
SELECT y, bin, CAST(n AS BIGINT) AS n, round(n / (sum(n) OVER (PARTITION BY y) * w), 6) AS density FROM c""")
def feature_histogram(spark, d):
    h = at.histogram(emb(spark, d).select("y", F.col("x")[0].alias("value")), ["y"])
    return h.select("y", "bin", "n", r6("density", "density"))


@query(f"WITH {q.dim()} SELECT pooling_op, representation, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT count(*) FROM dim WHERE importance > 0.5)::DOUBLE, 6) AS share FROM dim WHERE importance > 0.5 GROUP BY 1, 2")
def category_counts(spark, d):
    f = dim(spark).where("importance > 0.5").groupBy("pooling_op", "representation").agg(F.count("*").alias("n"))
    return f.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


@query(f"WITH {q.dim()} SELECT representation, round(median(importance), 6) AS med, round(quantile_cont(importance, 0.95), 6) AS p95, round(quantile_cont(importance, 0.97), 6) AS p97 FROM dim GROUP BY 1")
def medians_percentiles(spark, d):
    return dim(spark).groupBy("representation").agg(*[r6(F.percentile("importance", p), n) for p, n in ((0.5, "med"), (0.95, "p95"), (0.97, "p97"))])


@query(f"WITH {q.dim()} SELECT CAST(count(DISTINCT kernel_index) AS BIGINT) AS kernels, CAST(count(DISTINCT dilation) AS BIGINT) AS dilations FROM dim WHERE importance > 0.9")
def distinct_counts(spark, d):
    return dim(spark).where("importance > 0.9").agg(F.count_distinct("kernel_index").alias("kernels"), F.count_distinct("dilation").alias("dilations"))


FOLD = """fold AS (SELECT id, y, repeat, CAST((row_number() OVER (PARTITION BY repeat, y ORDER BY md5((repeat + 42) || ':fold:' || id), id) - 1) % 5 AS INT) AS fold
  FROM (SELECT vec_id AS id, label AS y FROM embeddings), (SELECT unnest(range(0, 2)) AS repeat))"""


@query(f"WITH {FOLD} SELECT id, y, CAST(repeat AS INT) AS repeat, fold FROM fold")
def stratified_folds(spark, d):
    return sampling.stratified_folds(emb(spark, d), 2, 5)


@query("""SELECT id, CAST(repeat AS INT) AS repeat, CAST((row_number() OVER (PARTITION BY repeat ORDER BY md5((repeat + 42) || ':fold:' || id), id) - 1) % 4 AS INT) AS fold
FROM (SELECT vec_id AS id FROM embeddings), (SELECT unnest(range(0, 2)) AS repeat)""")
def plain_folds(spark, d):
    return sampling.plain_folds(emb(spark, d), 2, 4)


@query(f"WITH {FOLD}, {q.PRED}, m AS (SELECT repeat, fold, avg(CASE WHEN pred = p.y THEN 1.0 ELSE 0 END) AS v FROM fold JOIN p USING (id) GROUP BY 1, 2) SELECT CAST(repeat AS INT) AS repeat, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1")
def cv_summary(spark, d):
    f = sampling.stratified_folds(emb(spark, d), 2, 5).select("id", "repeat", "fold")
    v = f.join(preds(spark, d), "id").groupBy("repeat", "fold").agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("value"))
    return metrics.summarise(v, "repeat").select("repeat", r6("mean", "mean"), r6("std", "std"), "n")


@query(f"WITH {FOLD} SELECT CAST(repeat AS INT) AS repeat, k AS fold, CAST(sum(CASE WHEN fold <> k THEN 1 ELSE 0 END) AS BIGINT) AS train, CAST(sum(CASE WHEN fold = k THEN 1 ELSE 0 END) AS BIGINT) AS test FROM fold, (SELECT unnest(range(0, 5)) AS k) GROUP BY 1, 2")
def fold_sizes(spark, d):
    f = sampling.stratified_folds(emb(spark, d), 2, 5).groupBy("repeat", "fold").agg(F.count("*").alias("test"))
    total = F.sum("test").over(Window.partitionBy("repeat"))
    return f.select("repeat", F.col("fold").cast("long").alias("fold"), (total - F.col("test")).alias("train"), "test")


TOPS = "tops AS (SELECT CAST(r AS INT) AS repeat, CAST(k AS INT) AS fold, CAST(f AS INT) AS feature_index FROM (SELECT unnest(range(0, 2)) AS r), (SELECT unnest(range(0, 5)) AS k), (SELECT unnest(range(0, 200)) AS f) WHERE (f * f + k * 17 + r * 13) % 11 < 7 OR f % 7 = 0 OR f % 7 = 1 AND (k + 2 * r) % 5 <> 0)"


def _tops(spark):
    g = spark.range(2).select(F.col("id").cast("int").alias("repeat")).crossJoin(spark.range(5).select(F.col("id").cast("int").alias("fold")))
    g = g.crossJoin(spark.range(200).select(F.col("id").cast("int").alias("feature_index")))  # 2,000 rows
    f, k, r = F.col("feature_index"), F.col("fold"), F.col("repeat")
    # in all folds, in eight of ten, and in fewer
    return g.where(((f * f + k * 17 + r * 13) % 11 < 7) | (f % 7 == 0) | ((f % 7 == 1) & ((k + 2 * r) % 5 != 0)))


@query(f"WITH {TOPS} SELECT feature_index, CAST(count(*) AS BIGINT) AS count, round(count(*) / 10.0::DOUBLE, 6) AS fraction FROM tops GROUP BY 1")
def stability_counts(spark, d):
    return selection.stability(_tops(spark)).select("feature_index", "count", r6("fraction", "fraction"))


@query(f"WITH {TOPS} SELECT feature_index, CAST(count(*) AS BIGINT) AS count FROM tops GROUP BY 1 HAVING count(*) >= 8")
def stable_features(spark, d):
    return selection.stable_features(selection.stability(_tops(spark)), 0.8).select("feature_index", "count")


@query(f"WITH {TOPS}, s AS (SELECT feature_index FROM tops GROUP BY 1 HAVING count(*) >= 8) SELECT s.feature_index, CAST(r AS INT) AS repeat, CAST(k AS INT) AS fold, CAST(count(tops.fold) AS INT) AS present FROM s, (SELECT unnest(range(0, 2)) AS r), (SELECT unnest(range(0, 5)) AS k) LEFT JOIN tops ON tops.feature_index = s.feature_index AND tops.repeat = r AND tops.fold = k GROUP BY 1, 2, 3")
def presence_matrix(spark, d):
    t = _tops(spark)
    return selection.presence(t, selection.stable_features(selection.stability(t), 0.8))


PHASE = "z AS (SELECT vec_id AS trial, unnest(CAST(embedding AS DOUBLE[])[1:32]) AS re, unnest(CAST(embedding AS DOUBLE[])[33:64]) AS im, unnest(range(0, 32)) AS frame FROM embeddings)"
TFA = f"""{PHASE}, u AS (SELECT *, sqrt(re * re + im * im) AS s FROM z),
w AS (SELECT frame, avg(re * re + im * im) AS ersp, avg(CASE WHEN s > 0 THEN re / s ELSE 0 END) AS a, avg(CASE WHEN s > 0 THEN im / s ELSE 0 END) AS b, count(*) AS n FROM u GROUP BY 1)"""


def _phase(spark, d):
    pair = F.arrays_zip(F.slice("x", 1, 32).alias("re"), F.slice("x", 33, 32).alias("im"))
    return emb(spark, d).select(F.col("id").alias("trial"), F.posexplode(pair).alias("frame", "z")).select("trial", "frame", "z.re", "z.im")


@query(f"WITH {TFA} SELECT CAST(frame AS INT) AS frame, round(ersp, 6) AS ersp, round(a, 6) + 0.0 AS itc_re, round(b, 6) + 0.0 AS itc_im, round(sqrt(a * a + b * b), 6) AS itc, round((n * (a * a + b * b) - 1) / greatest(n - 1, 1), 6) + 0.0 AS ppc FROM w")
def ersp_itc_ppc(spark, d):
    s = spectral.summarise_phase(_phase(spark, d), "frame")
    return s.select("frame", *[r6(c, c) for c in ("ersp", "itc_re", "itc_im", "itc", "ppc")])


def _tfa(spark, d):
    return spectral.summarise_phase(_phase(spark, d), "frame").withColumn("channel", F.lit(0)).withColumn("freq_lo", (F.col("frame") % 4).cast("double"))


@query(f"WITH {TFA}, g AS (SELECT frame, 10 * log10(ersp + 1e-20) AS v FROM w) SELECT CAST(frame AS INT) AS frame, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 5) + 0.0 AS value FROM g")
def baseline_zscore(spark, d):
    return spectral.baseline(_tfa(spark, d)).select("frame", (F.round("value", 5) + 0.0).alias("value"))


@query(f"WITH {TFA}, g AS (SELECT frame, 10 * log10(ersp + 1e-20) AS v FROM w) SELECT CAST(frame AS INT) AS frame, round(v - avg(CASE WHEN frame BETWEEN 0 AND 10 THEN v END) OVER (PARTITION BY frame % 4), 6) + 0.0 AS value FROM g")
def baseline_window(spark, d):
    return spectral.baseline(_tfa(spark, d), "window", 0, 10).select("frame", r6("value", "value"))


@query(f"WITH {TFA} SELECT CAST(frame AS INT) AS frame, round(greatest((n * (a * a + b * b) - 1) / greatest(n - 1, 1), 0), 6) AS ppc FROM w")
def tfa_panel(spark, d):
    return spectral.panel(_tfa(spark, d)).select("frame", r6("ppc", "ppc"))


@query("WITH s AS (SELECT unnest(range(0, 64)) AS t, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings), m AS (SELECT t, avg(abs(v)) AS v FROM s GROUP BY 1) SELECT CAST(t AS INT) AS t, round(v / max(v) OVER (), 6) AS value FROM m")
def mean_abs_attribution(spark, d):
    return saliency.mean_absolute(emb(spark, d).select(F.posexplode("x").alias("t", "v"))).select("t", r6("value", "value"))


@query("SELECT CAST(label AS INT) AS y, round(regr_slope(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE)), 6) + 0.0 AS slope, round(regr_intercept(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE)), 6) + 0.0 AS intercept, round(corr(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE)), 6) + 0.0 AS r FROM embeddings GROUP BY 1")
def trend_fit(spark, d):
    rows = emb(spark, d).select(F.col("y").alias("g"), F.col("x")[0].alias("value"), F.col("x")[1].alias("y"))
    return at.trend(rows, "g").select(F.col("g").alias("y"), r6("slope", "slope"), r6("intercept", "intercept"), r6("r", "r"))


# -- attribution -------------------------------------------------------------


@query(f"WITH {q.EMBED}, {q.PRED}, sp AS (SELECT series.id, series.y, p.pred = series.y AS correct, x FROM series JOIN p USING (id)), {q.act('sp', CHOSEN, True, 'id, y, correct')}, n AS (SELECT y, correct, count(*) AS n FROM sp GROUP BY 1, 2) SELECT act.y, act.correct, CAST(t AS INT) AS t, round(sum(imp * a) / any_value(n), 9) AS activation FROM act JOIN n ON n.y = act.y AND n.correct = act.correct GROUP BY 1, 2, 3")
def confusion_conditioned_maps(spark, d):
    return at.outcome_maps(emb(spark, d), preds(spark, d), CHOSEN).select("y", "correct", "t", F.round("activation", 9).alias("activation"))


MEANS = f"WITH {q.EMBED}, {q.class_mean('series')}"


@query(f"""{MEANS}, {q.act('means', CHOSEN, True, 'y')}, s AS (SELECT fi, d, t, max(a) - min(a) AS v FROM act GROUP BY 1, 2, 3), m AS (SELECT fi, d, sum(v) AS m, sum(t * v) AS w FROM s GROUP BY 1, 2)
SELECT fi AS feature_index, CAST(round_even(w / m, 0) AS INT) AS peak, CAST(greatest(0, round_even(w / m, 0) - (1 + 8 * d) // 2) AS INT) AS lo, CAST(least({L - 1}, round_even(w / m, 0) + (1 + 8 * d) // 2) AS INT) AS hi FROM m WHERE m > 0""")
def receptive_field_peaks(spark, d):
    means = at.class_mean_series(emb(spark, d))
    spread = at.activation_map(means, CHOSEN, True).groupBy("feature_index", "t").agg((F.max("act") - F.min("act")).alias("v")).groupBy("feature_index").agg(F.sum("v").alias("m")).where("m > 0")
    return at.receptive_fields(emb(spark, d), CHOSEN, L).join(F.broadcast(spread.select("feature_index")), "feature_index", "left_semi")


@query(f"{MEANS}, {q.act('means', [CHOSEN[1]], False, 'y')} SELECT y, CAST(t AS INT) AS t, round(c, 6) + 0.0 AS c, a AS act FROM act")
def class_mean_activation(spark, d):
    return at.class_mean_activation(emb(spark, d), CHOSEN, 1).select("y", "t", r6("c", "c"), "act")


@query(f"{MEANS}, {q.act('means', CHOSEN, False, 'y')} SELECT fi AS feature_index, CAST(t AS INT) AS t, max(a) AS fires FROM act GROUP BY 1, 2")
def multi_kernel_summary(spark, d):
    return at.multi_kernel_summary(emb(spark, d), CHOSEN)


@query(f"{MEANS}, {q.act('means', CHOSEN, False, 'y')} SELECT y, CAST(t AS INT) AS t, round(sum(a * imp) / {len(CHOSEN)}, 6) AS activation FROM act GROUP BY 1, 2")
def aggregate_activation(spark, d):
    return at.aggregate_activation(emb(spark, d), CHOSEN).select("y", "t", r6("activation", "activation"))


@query(f"WITH {q.dim()}, top AS (SELECT * FROM dim ORDER BY importance DESC, feature_index LIMIT 100), bot AS (SELECT * FROM dim ORDER BY importance, feature_index DESC LIMIT 100) SELECT part, dilation, pooling_op, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'top' AS part, * FROM top UNION ALL SELECT 'bottom', * FROM bot) GROUP BY 1, 2, 3")
def kernel_properties(spark, d):
    top, bottom = ranking.top_features(dim(spark), 100), ranking.bottom_features(dim(spark), 100)
    both = top.withColumn("part", F.lit("top")).unionByName(bottom.withColumn("part", F.lit("bottom")))
    return both.groupBy("part", "dilation", "pooling_op").agg(F.count("*").alias("n"))


@query(f"WITH {q.dim()}, s AS (SELECT * FROM dim WHERE importance > 0.8) SELECT representation, pooling_op, CAST(count(*) AS BIGINT) AS n_all, CAST(sum(CASE WHEN importance > 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS n_left, round(median(CASE WHEN importance > 0.8 THEN dilation END), 6) AS median_dilation FROM dim GROUP BY 1, 2")
def rfe_survivors(spark, d):
    f = dim(spark)
    left = F.col("importance") > 0.8
    return f.groupBy("representation", "pooling_op").agg(F.count("*").alias("n_all"), F.sum(left.cast("int")).alias("n_left"), r6(F.percentile(F.when(left, F.col("dilation")), 0.5), "median_dilation"))


# -- rankings, schedules, selection ------------------------------------------


@query(f"WITH {q.dim()} SELECT feature_index, round(importance, 6) AS importance FROM dim ORDER BY dim.importance DESC, feature_index LIMIT 20")
def top_features(spark, d):
    return ranking.top_features(dim(spark)).select("feature_index", r6("importance", "importance"))


@query(f"""WITH {q.dim()}, c AS (SELECT * FROM dim ORDER BY importance DESC, feature_index LIMIT 40), r AS (SELECT *, row_number() OVER (PARTITION BY representation, kernel_index, dilation ORDER BY importance DESC, feature_index) AS k FROM c)
SELECT feature_index, representation, kernel_index, dilation FROM r WHERE k = 1 ORDER BY importance DESC, feature_index LIMIT 10""")
def dedupe_kernels(spark, d):
    return ranking.distinct_kernels(dim(spark), 10).select("feature_index", "representation", "kernel_index", "dilation")


SAL = "sal AS (SELECT CAST(t AS INT) AS t, round(avg(abs(v)), 9) AS value FROM (SELECT unnest(range(0, 64)) AS t, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings) GROUP BY 1)"


def _sal(spark, d):
    return emb(spark, d).select(F.posexplode("x").alias("t", "v")).groupBy("t").agg(F.round(F.avg(F.abs("v")), 9).alias("value"))


@query(f"WITH {SAL}, r AS (SELECT t, row_number() OVER (ORDER BY value DESC, t) AS r FROM sal), f AS (SELECT unnest([0.05, 0.1, 0.25, 0.5]::DOUBLE[]) AS fraction) SELECT fraction, t FROM r, f WHERE r <= greatest(1, floor(fraction * 64 + 1e-9))")
def topk_mask(spark, d):
    m = saliency.top_times(_sal(spark, d), [0.05, 0.1, 0.25, 0.5], L)
    return m.select("fraction", F.explode("times").alias("t"))


@query(f"WITH {SAL}, v AS (SELECT t, (1 - value) AS v FROM sal) SELECT t, round(CASE WHEN max(v) OVER () > 0 THEN v / max(v) OVER () ELSE v END, 6) + 0.0 AS value FROM v")
def inverse_saliency(spark, d):
    return saliency.inverse_saliency(_sal(spark, d)).select("t", r6("value", "value"))


@query(f"WITH {SAL}, s AS (SELECT t, value, lead(value) OVER (ORDER BY t) AS nxt FROM sal), g AS (SELECT u, u * (63 / 99.0::DOUBLE) AS p FROM (SELECT unnest(range(0, 100)) AS u)) SELECT CAST(u AS INT) AS t, round(value + (p - t) * (coalesce(nxt, value) - value), 6) AS value FROM g JOIN s ON s.t = least(63, CAST(floor(p) AS INT))")
def resample_saliency(spark, d):
    return saliency.resampled(_sal(spark, d), 100).select("t", r6("value", "value"))


@query("SELECT label AS y, vec_id AS id FROM (SELECT *, row_number() OVER (ORDER BY label, vec_id) - 1 AS r FROM embeddings) WHERE r % ((SELECT count(*) FROM embeddings) // 10) = 0 ORDER BY r LIMIT 10")
def spread_by_target(spark, d):
    s = emb(spark, d).select("id", "y")
    return ranking.spread_by_target(s, 10, s.count()).select("y", "id")


@query("""WITH f AS (SELECT label, min(vec_id) AS id FROM embeddings GROUP BY 1), n AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings WHERE vec_id NOT IN (SELECT id FROM f))
SELECT id FROM f UNION ALL SELECT id FROM n WHERE r <= 15 - (SELECT count(*) FROM f)""")
def one_per_class_then_pad(spark, d):
    return occlusion.pick_rows(emb(spark, d), 15).select("id")


@query("SELECT DISTINCT CAST(floor(2016 * pow(0.95::DOUBLE, k)) AS INT) AS n_features FROM range(0, 150) r(k) WHERE floor(2016 * pow(0.95::DOUBLE, k)) > 0")
def rfe_schedule(spark, d):
    return spark.createDataFrame([(n,) for n in ranking.elimination_schedule(2016)], "n_features int")


CURVE = "c AS (SELECT label AS k, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS i, CAST(embedding[3] AS DOUBLE) AS v FROM embeddings)"


def _curve(spark, d):
    w = Window.partitionBy("y").orderBy("id")
    return emb(spark, d).select(F.col("y").alias("k"), (F.row_number().over(w) - 1).alias("i"), F.col("x")[2].alias("v"))


@query(f"""WITH {CURVE}, u AS (SELECT k, i, count(*) OVER (PARTITION BY k) AS n, (v - min(v) OVER (PARTITION BY k)) / (max(v) OVER (PARTITION BY k) - min(v) OVER (PARTITION BY k) + 1e-15) AS u FROM c),
e AS (SELECT k, arg_min(u, i) AS a, arg_max(u, i) AS b FROM u GROUP BY 1), d AS (SELECT u.k, i, n, round(abs(u - (a + (b - a) * i / (n - 1))), 12) AS d FROM u JOIN e USING (k))
SELECT k, CAST(i AS INT) AS knee FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC, i) AS r FROM d) WHERE r = 1""")
def kneedle(spark, d):
    return ranking.kneedle(_curve(spark, d), "k")


@query(f"""WITH {CURVE}, s AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY v DESC, i) - 1 AS INT) AS i, v, count(*) OVER (PARTITION BY k) AS n FROM c), e AS (SELECT k, arg_min(v, i) AS a, arg_max(v, i) AS b FROM s GROUP BY 1),
d AS (SELECT s.k, i, round(abs((b - a) * i - (n - 1) * (v - a)) / sqrt((n - 1) * (n - 1) + (b - a) * (b - a)), 12) AS d FROM s JOIN e USING (k))
SELECT k, CAST(i AS INT) AS elbow FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC, i) AS r FROM d) WHERE r = 1""")
def elbow(spark, d):
    w = Window.partitionBy("k").orderBy(F.desc("v"), "i")
    return ranking.elbow(_curve(spark, d).select("k", (F.row_number().over(w) - 1).alias("i"), "v"), "k")


DROPS = "dr AS (SELECT 'e' || (vec_id % 4) AS name, CASE vec_id // 4 % 2 WHEN 0 THEN 'zero' ELSE 'mean' END AS perturbation, (1 + vec_id // 8) * 0.05::DOUBLE AS fraction, abs(CAST(embedding[1] AS DOUBLE)) AS drop_ FROM embeddings)"


def _drops(spark, d):
    t = emb(spark, d)
    p = F.when((F.floor(F.col("id") / 4) % 2) == 0, "zero").otherwise("mean")
    return t.select(F.concat(F.lit("e"), (F.col("id") % 4).cast("string")).alias("name"), p.alias("perturbation"), ((1 + F.floor(F.col("id") / 8)) * 0.05).alias("fraction"), F.abs(F.col("x")[0]).alias("drop"))


AUC = f"{DROPS}, seg AS (SELECT name, perturbation, 0.5 * (drop_ + lag(drop_, 1, 0.0) OVER w) * (fraction - lag(fraction, 1, 0.0) OVER w) AS s FROM dr WINDOW w AS (PARTITION BY name, perturbation ORDER BY fraction)), auc AS (SELECT name, perturbation, sum(s) AS auc FROM seg GROUP BY 1, 2)"


@query(f"WITH {AUC} SELECT name, perturbation, round(auc, 6) AS auc FROM auc")
def auc_drop(spark, d):
    return saliency.evaluate(_drops(spark, d)).select("name", "perturbation", r6("auc", "auc"))


@query(f"WITH {AUC} SELECT name, round(avg(auc), 6) AS mean_auc, CAST(row_number() OVER (ORDER BY avg(auc) DESC, name) AS INT) AS rank FROM auc GROUP BY 1")
def explainer_ranking(spark, d):
    return saliency.rank(saliency.evaluate(_drops(spark, d))).select("name", r6("mean_auc", "mean_auc"), "rank")


def _perturb_sql(value: str, extra: str = "") -> str:
    return f"WITH {q.EMBED}{extra} SELECT id, CAST(unnest(range(0, 64)) AS INT) AS t, round(unnest(list_transform(range(1, 65), lambda i: CASE WHEN i - 1 IN {tuple(MASK)} THEN {value} ELSE x[i] END)), 6) + 0.0 AS v FROM series"


def _perturbed(spark, d, method):
    s = emb(spark, d)
    p = saliency.perturb(s, F.array(*[F.lit(i) for i in MASK]), method, saliency.value_stats(s) if method == "mean" else (0.0, 1.0))
    return p.select("id", F.posexplode("x").alias("t", "v")).select("id", "t", r6("v", "v"))


@query(_perturb_sql("0.0"))
def perturb_zero(spark, d):
    return _perturbed(spark, d, "zero")


@query(_perturb_sql("g.m", ", g AS (SELECT avg(v) AS m FROM (SELECT unnest(x) AS v FROM series))").replace("FROM series", "FROM series, g").replace("(SELECT unnest(x) AS v FROM series, g)", "(SELECT unnest(x) AS v FROM series)"))
def perturb_mean(spark, d):
    return _perturbed(spark, d, "mean")


@query(_perturb_sql(f"list_sum(list_filter(x, lambda v, j: j - 1 NOT IN {tuple(MASK)})) / {64 - len(MASK)}"))
def perturb_inverse(spark, d):
    return _perturbed(spark, d, "inverse")


@query("SELECT vec_id AS id, CAST(pos AS INT) AS pos, CAST(pos + 2 AS INT) AS last FROM embeddings, (SELECT unnest(range(0, 62, 1)) AS pos)")
def occlusion_windows(spark, d):
    w, s = occlusion.window_defaults(L)
    return occlusion.windows(emb(spark, d).select("id"), L, w, s).select("id", "pos", (F.col("pos") + w - 1).cast("int").alias("last"))


@query("""WITH w AS (SELECT vec_id AS id, pos, abs(CAST(embedding[pos + 1] AS DOUBLE)) AS impact FROM embeddings, (SELECT unnest(range(0, 58, 4)) AS pos))
SELECT g.id, CAST(g.t AS INT) AS t, round(coalesce(avg(impact), 0), 6) AS sensitivity FROM (SELECT DISTINCT id, t FROM w, (SELECT unnest(range(0, 64)) AS t)) g LEFT JOIN w ON w.id = g.id AND g.t >= pos AND g.t < pos + 6 GROUP BY 1, 2""")
def occlusion_average(spark, d):
    w = occlusion.windows(emb(spark, d), L, 6, 4).select("id", "pos", F.abs(F.get("x", "pos")).alias("impact"))
    return occlusion.spread_over_time(w, L, 6, "id").select("id", "t", r6("sensitivity", "sensitivity"))


NULLS = "nul AS (SELECT vec_id AS permutation, CAST(i AS INT) AS feature_index, abs(CAST(embedding[i + 1] AS DOUBLE)) AS importance FROM embeddings, (SELECT unnest(range(0, 64)) AS i)), obs AS (SELECT feature_index, max(importance) * (0.5 + (feature_index % 5) * 0.1::DOUBLE) AS importance FROM nul GROUP BY 1)"


@query(f"WITH {NULLS} SELECT feature_index, round(avg(CASE WHEN nul.importance >= obs.importance THEN 1.0 ELSE 0 END), 6) AS p_value, round(quantile_cont(nul.importance, 0.95), 6) AS null_p95, avg(CASE WHEN nul.importance >= obs.importance THEN 1.0 ELSE 0 END) < 0.05 AS significant FROM obs JOIN nul USING (feature_index) GROUP BY 1")
def pimp_pvalues(spark, d):
    null = emb(spark, d).select(F.col("id").alias("permutation"), F.posexplode("x").alias("feature_index", "v")).select("permutation", "feature_index", F.abs("v").alias("importance"))
    obs = null.groupBy("feature_index").agg((F.max("importance") * (0.5 + (F.col("feature_index") % 5) * 0.1)).alias("importance"))
    return selection.permutation_p(obs, null).select("feature_index", r6("p_value", "p_value"), r6("null_p95", "null_p95"), "significant")


@query("""WITH g AS (SELECT 'K' || vec_id AS "group", abs(CAST(embedding[1] AS DOUBLE)) AS s, abs(CAST(embedding[2] AS DOUBLE)) AS r, 1.0::DOUBLE AS a FROM embeddings)
SELECT "group", round(a - r, 6) AS contribution, round(a - r - s, 6) + 0.0 AS p, CASE WHEN a - r - s < -0.1 THEN 'redundant' WHEN a - r - s > 0.1 THEN 'synergistic' ELSE 'independent' END AS kind FROM g""")
def information_classes(spark, d):
    g = emb(spark, d).select(F.format_string("K%d", "id").alias("group"), F.abs(F.col("x")[0]).alias("i_single"), F.abs(F.col("x")[1]).alias("i_rest"), F.lit(1.0).alias("i_all"))
    return selection.classify_information(g, 0.1).select("group", r6("contribution", "contribution"), r6("p", "p"), "kind")


@query(f"""WITH {q.dim()}, t AS (SELECT * FROM dim ORDER BY importance DESC, feature_index LIMIT 50), n AS (SELECT *, row_number() OVER (ORDER BY feature_index) - 1 AS position FROM t)
SELECT 'K' || kernel_index || '-d' || dilation AS "group", CAST(position AS INT) AS position, feature_index FROM n""")
def feature_groups(spark, d):
    return selection.feature_groups(ranking.top_features(dim(spark), 50), "kernel_dilation")


@query("""WITH r AS (SELECT vec_id AS id, label AS y, row_number() OVER (PARTITION BY label ORDER BY md5('42:split:' || vec_id), vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT id, y, CASE WHEN r <= floor(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM r""")
def stratified_split(spark, d):
    return sampling.stratified_split(emb(spark, d))


@query("""WITH r AS (SELECT rep, label % 2 AS condition, vec_id AS id, row_number() OVER (PARTITION BY rep, label % 2 ORDER BY md5((rep + 42) || ':match:' || vec_id), vec_id) AS r FROM embeddings, (SELECT unnest(range(0, 4)) AS rep)),
n AS (SELECT floor(min(c) * 0.8::DOUBLE) AS n FROM (SELECT count(*) AS c FROM embeddings GROUP BY label % 2)) SELECT CAST(rep AS INT) AS rep, condition, id FROM r, n WHERE r <= n""")
def match_trials(spark, d):
    return sampling.match_trials(emb(spark, d).withColumn("condition", F.col("y") % 2), "condition", 4)


@query("""WITH b AS (SELECT vec_id AS id, label AS y FROM embeddings), a AS (SELECT p, id, row_number() OVER (PARTITION BY p ORDER BY id) AS r FROM b, (SELECT unnest(range(0, 3)) AS p)),
c AS (SELECT p, y, row_number() OVER (PARTITION BY p ORDER BY md5((p + 42) || ':permute:' || id), id) AS r FROM b, (SELECT unnest(range(0, 3)) AS p))
SELECT CAST(a.p AS INT) AS permutation, id, y FROM a JOIN c ON a.p = c.p AND a.r = c.r""")
def permuted_labels(spark, d):
    return sampling.permuted_labels(emb(spark, d), 3)


@query("""WITH d AS (SELECT round(CAST(embedding[1] AS DOUBLE), 1) - round(CAST(embedding[2] AS DOUBLE), 1) AS d FROM embeddings), z AS (SELECT round(d, 6) AS d FROM d WHERE round(d, 6) <> 0),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM z), s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM r)
SELECT CAST(n AS BIGINT) AS n, CAST(w_plus AS DOUBLE) AS w_plus, CAST(w_minus AS DOUBLE) AS w_minus, round((w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 6) AS z FROM s""")
def signed_rank_test(spark, d):
    e = emb(spark, d).select(F.round(F.round(F.col("x")[0], 1) - F.round(F.col("x")[1], 1), 6).alias("a"), F.lit(0.0).alias("b"))
    return selection.signed_rank(e).select("n", "w_plus", "w_minus", r6("z", "z"))


# -- channels ----------------------------------------------------------------

PROTO = f"WITH {q.CHANNELS}, cp AS (SELECT channel, y, unnest(x) AS v, unnest(range(0, 30)) AS t FROM channels), pr AS (SELECT channel, y, t, avg(v) AS m FROM cp GROUP BY 1, 2, 3), dd AS (SELECT a.channel, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM pr a JOIN pr b ON a.channel = b.channel AND a.t = b.t AND a.y < b.y GROUP BY a.channel, a.y, b.y), dist AS (SELECT CAST(channel AS INT) AS channel, sum(d) AS distance FROM dd GROUP BY 1), rk AS (SELECT *, row_number() OVER (ORDER BY distance DESC, channel) - 1 AS rank, count(*) OVER () AS n FROM dist)"


@query(PROTO + " SELECT CAST(channel AS INT) AS channel, y, CAST(t AS INT) AS t, round(m, 6) AS mean FROM pr")
def channel_prototypes(spark, d):
    return ch.prototypes(src.events_channels(spark, d)).select("channel", "y", "t", r6("mean", "mean"))


@query(PROTO + " SELECT channel, round(distance, 6) AS distance FROM dist")
def channel_distance(spark, d):
    return ch.distances(src.events_channels(spark, d)).select("channel", r6("distance", "distance"))


@query(PROTO + """, e AS (SELECT max(CASE WHEN rank = 0 THEN distance END) AS a, max(CASE WHEN rank = n - 1 THEN distance END) AS b, any_value(n) AS n FROM rk),
f AS (SELECT rank, round(abs((b - a) * rank - (e.n - 1) * (distance - a)) / sqrt((e.n - 1) * (e.n - 1) + (b - a) * (b - a)), 12) AS d FROM rk, e), k AS (SELECT rank AS elbow FROM f ORDER BY d DESC, rank LIMIT 1)
SELECT channel, CAST(rank AS INT) AS rank FROM rk, k WHERE rank <= elbow""")
def channels_elbow(spark, d):
    return ch.select(src.events_channels(spark, d), "elbow").select("channel", "rank")


@query(PROTO + " SELECT channel, CAST(rank AS INT) AS rank FROM rk WHERE rank < greatest(1, floor(n * 0.5::DOUBLE))")
def channels_top(spark, d):
    return ch.select(src.events_channels(spark, d), "top", fraction=0.5).select("channel", "rank")


@query(PROTO + ", j AS (SELECT id, rank, x FROM channels JOIN rk USING (channel) WHERE rank < 3), fl AS (SELECT id, flatten(list(x ORDER BY rank)) AS x FROM j GROUP BY 1) SELECT id, CAST(len(x) AS INT) AS n, round(x[1], 6) AS first_value, round(x[len(x)], 6) AS last_value FROM fl")
def flatten_channels(spark, d):
    s = src.events_channels(spark, d)
    f = ch.flatten(s, ch.select(s, "top", k=3))
    return f.select("id", F.size("x").alias("n"), r6(F.col("x")[0], "first_value"), r6(F.element_at("x", -1), "last_value"))


@query(None)
def channel_warping(spark, d):
    return ch.distances(src.events_channels(spark, d), "dtw")

"""Queries that apply a given bank and given coefficients, or fit two columns.

What a model does with its numbers is expressible in SQL even where the search
for them is not; so prediction, importance, counts and the ridge itself are held
against DuckDB here.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chronolens.functions.plan import BankPlan
from chronolens.operators import model, ridge, saliency
from chronolens.operators import transform as tr
from chronolens.operators.attribution import Feature

from . import sqltext as q
from .catalog import emb, query, r6

PLAN = BankPlan(64, 1000, 32)
BANK = tr.Bank(PLAN, np.array([((b * 37) % 11 - 5) / 20 for b in range(PLAN.width // 4)]))
#: Places of the bank that have coefficients.
PLACES = [3, 90, 200, 252 + 40, 252 + 101, 252 + 230]
#: (feature, mean, scale, coefficients of three classes).
TERMS = [(4 * b + i % 4, 0.25 * i, 1.0 + 0.5 * i, [((i * 5 + k * 3) % 7 - 3) / 8 for k in range(3)]) for i, b in enumerate(PLACES)]
INTERCEPT = [0.625, -6.125, 2.1875]  # scores lie close together, so all classes are predicted


def _feature(b: int) -> Feature:
    rep, d, k, _ = PLAN.columns()[b]
    return Feature(4 * b, rep, d, k, float(BANK.biases[b]))


def _given() -> model.Model:
    mean, scale, coef = np.zeros(PLAN.width), np.ones(PLAN.width), np.zeros((3, PLAN.width))
    for f, m, s, c in TERMS:
        mean[f], scale[f], coef[:, f] = m, s, c
    return model.Model(BANK, ridge.Ridge(mean, scale, coef, np.array(INTERCEPT), 1.0, np.zeros(1)), [0, 1, 2])


#: long_f(id, y, fi, v): the four features of each place, in single precision.
POOLS = f"""{q.EMBED}, {q.act('series', [_feature(b) for b in PLACES], False)},
g AS (SELECT id, fi, t, t - row_number() OVER (PARTITION BY id, fi, a ORDER BY t) AS grp, a FROM act),
longest AS (SELECT id, fi, max(n) AS n FROM (SELECT id, fi, grp, count(*) AS n FROM g WHERE a = 1 GROUP BY 1, 2, 3) GROUP BY 1, 2),
pools AS (SELECT id, y, fi, sum(a) / CAST(count(*) AS DOUBLE) AS ppv, coalesce(avg(CASE WHEN a = 1 THEN c - b END), 0) AS mpv, coalesce(avg(CASE WHEN a = 1 THEN t END), -1) AS mipv FROM act GROUP BY 1, 2, 3),
both_f AS (SELECT p.id, p.y, p.fi, [ppv, mpv, mipv, coalesce(n, 0)] AS vs FROM pools p LEFT JOIN longest l ON p.id = l.id AND p.fi = l.fi),
long_f AS (SELECT id, y, CAST(fi + i AS INT) AS fi, CAST(CAST(vs[i + 1] AS FLOAT) AS DOUBLE) AS v FROM both_f, (SELECT unnest(range(0, 4)) AS i))"""

_TABLE = ", ".join(f"({f}, {m}::DOUBLE, {s}::DOUBLE, {c[0]}::DOUBLE, {c[1]}::DOUBLE, {c[2]}::DOUBLE)" for f, m, s, c in TERMS)


def _scores(zeroed=()) -> str:
    gone = ", ".join(str(f) for f in [-1, *zeroed])
    sums = ", ".join(f"sum(c{k} * (CASE WHEN term.fi IN ({gone}) THEN 0 ELSE v END - m) / s) + ({INTERCEPT[k]}) AS s{k}" for k in range(3))
    return f"""term AS (SELECT * FROM (VALUES {_TABLE}) t(fi, m, s, c0, c1, c2)),
sc AS (SELECT id, y, {sums} FROM long_f JOIN term USING (fi) GROUP BY 1, 2),
pr AS (SELECT *, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS pred FROM sc)"""


_SCORED = "SELECT id, y, round(s0, 4) + 0.0 AS s0, round(s1, 4) + 0.0 AS s1, round(s2, 4) + 0.0 AS s2, CAST(pred AS BIGINT) AS pred FROM pr"


def _r4(c):
    return F.round(c, 4) + F.lit(0.0)


def _split(scored):
    return scored.select("id", "y", *[_r4(F.col("scores")[k]).alias(f"s{k}") for k in range(3)], "pred")


@query(f"WITH {POOLS} SELECT id, fi AS feature_index, round(v, 4) + 0.0 AS value FROM long_f")
def given_transform(spark, d):
    """The bulk transform's features at six places of a given bank."""
    wanted = [4 * b + p for b in PLACES for p in range(4)]
    return tr.features_long(tr.transform(emb(spark, d).select("id", "x"), BANK)).where(F.col("feature_index").isin(wanted)).select("id", "feature_index", _r4(F.col("value").cast("double")).alias("value"))


@query(f"WITH {POOLS}, {_scores()} {_SCORED}")
def given_decision(spark, d):
    """Decision function and prediction of a given model."""
    return _split(model.decision(emb(spark, d), _given()))


@query(f"WITH {POOLS}, {_scores([TERMS[1][0], TERMS[4][0]])} {_SCORED}")
def given_masked_decision(spark, d):
    """The same with two features set to zero before scaling."""
    gone = {TERMS[1][0], TERMS[4][0]}
    return _split(model.decision(emb(spark, d), _given(), [f for f in range(PLAN.width) if f not in gone]))


@query(f"WITH {POOLS}, {_scores()} SELECT CAST(y AS INT) % 3 AS y, CAST(pred AS INT) AS pred, CAST(count(*) AS BIGINT) AS n FROM pr GROUP BY 1, 2")
def given_tallies(spark, d):
    """Counts by label and prediction that tasks add up for a refit."""
    m = _given()
    t = model.tallies(emb(spark, d).withColumn("y", F.col("y") % 3), BANK, m.classes, [(None, m.ridge)])[0]
    return spark.createDataFrame([(i, j, int(t[i, j])) for i in range(3) for j in range(3) if t[i, j]], "y int, pred int, n long")


@query(f"WITH {POOLS}, {_scores()} SELECT id, round(greatest(s0, s1, s2), 4) + 0.0 AS confidence, round(s1, 4) + 0.0 AS target FROM pr")
def given_predict_functions(spark, d):
    """Predict functions of a given model: best score, one class's score."""
    m, s = _given(), emb(spark, d)
    a = saliency.predict_column(m)(s).select("id", _r4(F.col("value")).alias("confidence"))
    return a.join(saliency.predict_column(m, "target", 1)(s).select("id", _r4(F.col("value")).alias("target")), "id")


@query(f"WITH term AS (SELECT * FROM (VALUES {_TABLE}) t(fi, m, s, c0, c1, c2)), n AS (SELECT fi, sqrt(c0 * c0 + c1 * c1 + c2 * c2) AS v FROM term) SELECT CAST(fi AS INT) AS feature_index, round(v / max(v) OVER (), 6) AS importance FROM n WHERE v > 0")
def given_importance(spark, d):
    """Norms of a given model's coefficients as shares of the largest."""
    return model.importance_df(spark, _given()).where("importance > 0").select("feature_index", r6("importance", "importance"))


#: Columns and penalty of the small ridge.
PAIR, PENALTY = (TERMS[0][0], TERMS[3][0]), 2.0

_RIDGE = f"""f AS (SELECT id, max(y)::DOUBLE AS y, max(CASE WHEN fi = {PAIR[0]} THEN v END) AS a, max(CASE WHEN fi = {PAIR[1]} THEN v END) AS b FROM long_f GROUP BY 1),
st AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM f),
z AS (SELECT y - my AS r, (a - ma) / sa AS u, (b - mb) / sb AS w, n, my FROM f, st),
e AS (SELECT sum(u * u) + {PENALTY} AS uu, sum(u * w) AS uw, sum(w * w) + {PENALTY} AS ww, sum(u * r) AS ur, sum(w * r) AS wr, any_value(n) AS n, any_value(my) AS my FROM z),
co AS (SELECT *, uu * ww - uw * uw AS det, (ww * ur - uw * wr) / (uu * ww - uw * uw) AS cu, (uu * wr - uw * ur) / (uu * ww - uw * uw) AS cw FROM e),
lo AS (SELECT avg(((r - cu * u - cw * w) / (1 - 1.0::DOUBLE / co.n - (ww * u * u - 2 * uw * u * w + uu * w * w) / det)) ** 2) AS loo FROM z, co)"""


def _pair(spark, d):
    s = emb(spark, d).select("id", "x", F.col("y").cast("double").alias("y"))
    return model.Refits(s, BANK, None).fit(list(PAIR), [PENALTY])


@query(f"WITH {POOLS}, {_RIDGE} SELECT round(cu, 6) AS first, round(cw, 6) AS second, round(my, 6) AS intercept, round(loo, 5) AS loo FROM co, lo")
def ridge_of_two_columns(spark, d):
    """Ridge with a fixed penalty on two features, and its leave-one-out error."""
    r = _pair(spark, d)
    return spark.createDataFrame([(round(float(r.coef[0, 0]), 6), round(float(r.coef[0, 1]), 6), round(float(r.intercept[0]), 6), round(float(r.loo[0]), 5))], "first double, second double, intercept double, loo double")


@query(f"WITH {POOLS}, {_RIDGE} SELECT CAST(any_value(n) AS BIGINT) AS n, round(1 - sum((r - cu * u - cw * w) ** 2) / sum(r * r), 6) AS r2 FROM (SELECT r, u, w, co.cu, co.cw, co.n FROM z, co)")
def ridge_score_of_two_columns(spark, d):
    """r2 of that ridge from sums that tasks add up."""
    s = emb(spark, d).select("id", "x", F.col("y").cast("double").alias("y"))
    n, a, sq, e = model.tallies(s, BANK, None, [(list(PAIR), _pair(spark, d))])[0]
    return spark.createDataFrame([(int(n), round(float(1 - e / (sq - a * a / n)), 6))], "n long, r2 double")

"""Queries that fit or apply a model: beyond SQL, so checked by tests instead.

Most run on generated bumps, where the truth is known; sizes are those of the
generators, not limits on a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens.operators import attribution as at
from chronolens.operators import metrics, model, occlusion, ranking, saliency, sampling, selection, spectral
from chronolens.operators import transform as tr
from chronolens.sources import series as src
from chronolens.sources import synthetic

QUERIES = {}
SMALL = dict(num_features=500, max_dilations=32)


def query(f):
    QUERIES[f.__name__] = f
    return f


def _bumps(spark, n=300, seed=42):
    return synthetic.bumps(spark, n, seed=seed)


def _model(spark, n=300, **config):
    return model.fit_classifier(_bumps(spark, n), **{**SMALL, **config})


@query
def bulk_transform(spark: SparkSession, d: str) -> DataFrame:
    """The whole bank over all embeddings: mean of each pooling operator."""
    e = src.embeddings(spark, d)
    bank = tr.fit_bank(e, 1000, 32)
    long = tr.features_long(tr.transform(e, bank))
    return long.groupBy((F.col("feature_index") % 4).alias("pooling_index")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query
def score_embeddings(spark, d):
    """Fit on four fifths of the embeddings, predict the rest."""
    e = src.embeddings(spark, d)
    m = model.fit_classifier(e.where("id % 5 <> 0"), **SMALL)
    return metrics.classification(model.predict(e.where("id % 5 = 0"), m))


@query
def fit_predict_bumps(spark, d):
    return metrics.classification(model.predict(_bumps(spark, 100, 99), _model(spark)))


@query
def balanced_bumps(spark, d):
    s = _bumps(spark).where("y <> 2 OR id % 4 = 0")
    return metrics.classification(model.predict(_bumps(spark, 100, 99), model.fit_classifier(s, class_weight="balanced", **SMALL)))


@query
def model_summary(spark, d):
    return model.summary(spark, _model(spark))[0]


@query
def feature_importance(spark, d):
    return ranking.top_features(model.importance_df(spark, _model(spark)), 20).drop("weights")


@query
def cross_validated_bumps(spark, d):
    return selection.cross_validate(_bumps(spark, 200), 1, 3, **SMALL)[0]


@query
def stability_bumps(spark, d):
    return selection.stability(selection.fold_importance(_bumps(spark, 150), 1, 3, 20, **SMALL))


@query
def elimination_bumps(spark, d):
    return selection.eliminate(_model(spark), _bumps(spark), _bumps(spark, 100, 99), 0.3, 12)[0]


@query
def information_bumps(spark, d):
    m = _model(spark)
    mask = [r[0] for r in ranking.top_features(model.importance_df(spark, m), 30).select("feature_index").collect()]
    return selection.information_decomposition(m, _bumps(spark, 100, 99), mask, shuffles=20)


@query
def permutation_bumps(spark, d):
    from pyspark.ml.classification import RandomForestClassifier

    m = _model(spark, 120, num_features=84)
    return selection.permutation_importance(m, _bumps(spark, 120), 2, RandomForestClassifier(numTrees=10, maxDepth=4, seed=1))


@query
def temporal_importance_bumps(spark, d):
    top = at.from_importance(ranking.distinct_kernels(model.importance_df(spark, _model(spark)), 12))
    return at.temporal_importance(_bumps(spark), top, 100)


@query
def occlusion_bumps(spark, d):
    return occlusion.aggregate_occlusion(_bumps(spark, 30, 99), _model(spark))


@query
def occlusion_saliency_bumps(spark, d):
    return occlusion.occlusion_saliency(_bumps(spark, 60, 99), _model(spark), rows=12)


@query
def saliency_ranking_bumps(spark, d):
    m = _model(spark)
    test = _bumps(spark, 40, 99)
    o = occlusion.occlusion_saliency(test, m, rows=9)
    maps = o.withColumn("name", F.lit("occlusion")).unionByName(saliency.random_saliency(spark, 100).withColumn("name", F.lit("random")))
    maps = maps.unionByName(saliency.inverse_saliency(o).withColumn("name", F.lit("inverse")))
    return saliency.rank(saliency.evaluate(saliency.accuracy_drops(test, m, maps, (0.1, 0.3), ("zero", "noise"))))


@query
def shapley_bumps(spark, d):
    m = _model(spark)
    v = saliency.shapley_windows(_bumps(spark, 8, 99), m, _bumps(spark, 20, 7), permutations=4)
    return saliency.mean_absolute(v)


@query
def regression_fit(spark, d):
    s = synthetic.regression(spark, 300)
    m = model.fit_regressor(s.where("id % 4 <> 0"), **SMALL)
    return metrics.regression(model.predict(s.where("id % 4 = 0"), m))


@query
def regression_folds(spark, d):
    return selection.cross_validate(synthetic.regression(spark, 150, 60), 1, 3, is_regression=True, num_features=168)[0]


@query
def regression_occlusion(spark, d):
    s = synthetic.regression(spark, 200)
    m = model.fit_regressor(s, **SMALL)
    o = occlusion.occlusion(occlusion.pick_rows(s, 5, True), m)
    return o.groupBy("t").agg(F.avg("sensitivity").alias("sensitivity"))


@query
def regression_elimination(spark, d):
    s = synthetic.regression(spark, 200)
    m = model.fit_regressor(s.where("id % 4 <> 0"), **SMALL)
    return selection.eliminate(m, s.where("id % 4 <> 0"), s.where("id % 4 = 0"), 0.3, 10)[0]


@query
def occlusion_by_row(spark, d):
    """Sensitivity of six rows of the embeddings to each occluded timepoint."""
    e = src.embeddings(spark, d)
    m = model.fit_classifier(e, **SMALL)
    return occlusion.occlusion(occlusion.pick_rows(e, 6, False), m)


@query
def predict_functions(spark, d):
    """Confidence, a class's score and the label of every embedding, averaged by label."""
    e = src.embeddings(spark, d)
    m = model.fit_classifier(e, **SMALL)
    out = None
    for mode, target in (("confidence", None), ("target", m.classes[0]), ("predict", None)):
        v = saliency.predict_column(m, mode, target)(e).groupBy("y").agg(F.avg("value").alias("value")).withColumn("mode", F.lit(mode))
        out = v if out is None else out.unionByName(v)
    return out


@query
def noise_search(spark, d):
    return spark.createDataFrame([(0.1, synthetic.noise_for_error(spark, 0.1, 0.005, 12))], "target double, noise_std double")


@query
def bayes_error(spark, d):
    return synthetic.bayes_error(spark, noise_std=1.0)


@query
def calibration_table(spark, d):
    return synthetic.calibration(spark, (0.5, 1.0, 2.0, 4.0))


@query
def demo_signals(spark, d):
    return synthetic.sample_signals(spark).select("name", F.size("x").alias("n"))


@query
def single_bump_data(spark, d):
    return synthetic.single_bump(spark).groupBy("y").agg(F.count("*").alias("n"))


@query
def step_data(spark, d):
    return synthetic.steps(spark).groupBy("y").agg(F.count("*").alias("n"))


@query
def multichannel_selection(spark, d):
    from chronolens.operators import channels

    return channels.select(synthetic.multichannel(spark, 60), "elbow").select("channel", "rank")


def _trials(spark, d):
    s = src.orders_monthly(spark, d)
    return s.select(F.lit(0).alias("channel"), F.col("id").alias("trial"), "x")


@query
def filtered_trials(spark, d):
    t = spectral.filtered(_trials(spark, d), 100.0, 30.0, 0)
    return t.select("trial", F.posexplode("x").alias("frame", "v")).groupBy("frame").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


@query
def hilbert_tfa(spark, d):
    return spectral.hilbert_tfa(_trials(spark, d), 80.0, 10, 30, 5)


@query
def bootstrap_thresholds(spark, d):
    z = spectral.analytic_signals(_trials(spark, d), 80.0, [(10.0, 20.0)])
    return spectral.bootstrap_thresholds(z, 20)


@query
def matched_power(spark, d):
    t = _trials(spark, d).withColumn("condition", (F.col("trial") % 2).cast("int"))
    picks = sampling.match_trials(t.select(F.col("trial").alias("id"), "condition"), "condition", 3)
    return spectral.power_spectrum(spectral.matched(t, picks, "condition"), 80.0, "rep", "condition").groupBy("condition", "freq").agg(F.avg("power").alias("power"))


def _matched(spark, d, trials):
    """Trials of three matched draws of two conditions."""
    t = trials.withColumn("condition", (F.col("trial") % 2).cast("int"))
    ids = t.select(F.col("trial").alias("id"), "condition").distinct()
    return spectral.matched(t, sampling.match_trials(ids, "condition", 3), "condition")


@query
def matched_time_frequency(spark, d):
    t = _matched(spark, d, _trials(spark, d).drop("channel")).withColumn("channel", F.col("condition") * 100 + F.col("rep"))
    return spectral.hilbert_tfa(t.select("channel", "trial", "x"), 80.0, 10, 30, 3)


@query
def matched_mode_spectrum(spark, d):
    t = _trials(spark, d)
    condition = (F.col("trial") % 2).cast("int").alias("condition")
    picks = sampling.match_trials(t.select(F.col("trial").alias("id"), condition).distinct(), "condition", 3)
    modes = spectral.decompose(t, 80.0, 3).select("*", condition)
    return spectral.matched_spectrum(modes, picks, "condition", 0, 40, 20)


@query
def compared_panels(spark, d):
    t = _trials(spark, d)
    return spectral.compare_panels({n: spectral.hilbert_tfa(t.where(F.col("trial") % 2 == k), 80.0, 10, 30, 3) for k, n in enumerate(("even", "odd"))})


@query
def phase_amplitude(spark, d):
    return spectral.phase_amplitude(_trials(spark, d), 80.0, [(4.0, 8.0)], [(15.0, 25.0), (25.0, 35.0)])


@query
def mode_spectrum(spark, d):
    return spectral.marginal_spectrum(spectral.decompose(_trials(spark, d), 80.0, 3), 0, 40, 20)

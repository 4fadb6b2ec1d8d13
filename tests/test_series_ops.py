"""Series operators against NumPy, golden values and ground truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.functions import arrays
from chronolens.functions.plan import KERNELS, BankPlan, decode, dilation_plan, feature_dim, kernel_weights, kernels_df
from chronolens.operators import attribution as at
from chronolens.operators import channels, metrics, model, occlusion, ranking, ridge, saliency, sampling, selection, spectral
from chronolens.operators import transform as tr
from chronolens.operators.attribution import Feature
from chronolens.sources import series as src
from chronolens.sources import synthetic

SMALL = dict(num_features=500, max_dilations=32)


def conv_brute(x, k, d):
    w, n = kernel_weights(k), len(x)
    return np.array([sum(w[j] * x[t + (j - 4) * d] for j in range(9) if 0 <= t + (j - 4) * d < n) for t in range(n)])


def pool_brute(c, b):
    hit = c > b
    run = best = 0
    for h in hit:
        run = run + 1 if h else 0
        best = max(best, run)
    t = np.arange(len(c))
    return [hit.mean(), (c[hit] - b).mean() if hit.any() else 0.0, t[hit].mean() if hit.any() else -1.0, best]


@pytest.fixture(scope="module")
def bumps(spark):
    return synthetic.bumps(spark, 300, seed=42).cache()


@pytest.fixture(scope="module")
def test_bumps(spark):
    return synthetic.bumps(spark, 100, seed=99).cache()


@pytest.fixture(scope="module")
def fitted(bumps):
    return model.fit_classifier(bumps, num_features=1000, max_dilations=32)


# -- plan --------------------------------------------------------------------

GOLDEN = [
    (21, 10000, 16, [1, 2], [7, 7]),
    (20, 10000, 32, [1, 2], [3, 4]),
    (30, 10000, 16, [1, 3], [7, 7]),
    (64, 10000, 16, [1, 2, 7], [7, 7, 8]),
    (64, 1000, 32, [1, 2, 7], [1, 1, 1]),
    (100, 1000, 32, [1, 2, 5, 12], [1, 1, 1, 1]),
    (200, 10000, 16, [1, 2, 4, 11, 24], [7, 7, 8, 7, 8]),
    (1024, 10000, 16, [1, 2, 5, 11, 25, 56, 127], [7, 7, 8, 7, 8, 7, 8]),
    (16, 10000, 16, [1], [7]),
]


@pytest.mark.parametrize("row", GOLDEN)
def test_plan(row):
    length, nf, md, dilations, biases = row
    assert dilation_plan(length, nf, md) == (dilations, biases)


def test_plan_edges(spark):
    with pytest.raises(ValueError):
        dilation_plan(100, 83, 16)
    assert BankPlan(100, 1000, 32).width == 2688
    k = kernels_df(spark).orderBy("kernel_index").collect()
    assert [(r.i0, r.i1, r.i2) for r in k] == list(KERNELS) and [r.kernel_index for r in k] == list(range(84))
    plan = BankPlan(64, 1000, 32)
    rows = {r.feature_index: r for r in feature_dim(spark, plan).collect()}
    assert len(rows) == plan.width
    for i in (0, 5, 1007, 1008, plan.width - 1):
        assert decode(plan, i)["kernel_index"] == rows[i].kernel_index and decode(plan, i)["dilation"] == rows[i].dilation
    for i in (-1, plan.width):
        with pytest.raises(ValueError):
            decode(plan, i)


# -- transform ---------------------------------------------------------------


@pytest.mark.parametrize("d", [1, 2, 7])
def test_convolution_and_pools(spark, d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(5, 40))
    df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "id long, x array<double>, y int")
    for k in (0, 17, 83):
        bias = 0.3 if k else 1e9
        f = Feature(0, "raw", d, k, bias)
        got = {r.id: r for r in at.pooled(df, [f]).collect()}
        conv = {r.id: r.c for r in at.convolution_rows(df, [f]).collect()}
        bulk = dict(tr.convolutions(x, d))[k]
        for i in range(5):
            want = conv_brute(x[i], k, d)
            assert np.allclose(conv[i], want) and np.allclose(bulk[i], want)
            p = pool_brute(want, bias)
            assert np.allclose([got[i].ppv, got[i].mpv, got[i].mipv, got[i].lspv], p)
            assert np.allclose(tr.pooled(bulk[i : i + 1], np.array([bias]))[0, 0], p)


def test_bulk_equals_arrays(spark, bumps, fitted):
    some = bumps.where("id < 4")
    rows = {r.id: r.features for r in tr.transform(some, fitted.bank).collect()}
    cols = fitted.bank.plan.columns()
    picks = [3, 400, 600]
    for b in picks:
        rep, d, k, _ = cols[b]
        for r in at.pooled(some, [Feature(b, rep, d, k, float(fitted.bank.biases[b]))]).collect():
            assert np.allclose(rows[r.id][4 * b : 4 * b + 4], [r.ppv, r.mpv, r.mipv, r.lspv], atol=1e-4)


def test_invariants(spark, bumps, fitted):
    f = np.array([r.features for r in tr.transform(bumps.where("id < 20"), fitted.bank).collect()]).reshape(20, -1, 4)
    assert not np.isnan(f).any() and f.shape[1] * 4 == 2688
    assert ((f[..., 0] >= 0) & (f[..., 0] <= 1)).all()
    assert (f[..., 0] * 100 + 1.01 >= f[..., 3]).all()
    assert ((f[..., 2] == -1) | ((f[..., 2] >= 0) & (f[..., 2] <= 99))).all()


def test_bad_rows(spark, fitted):
    for x in ([1.0] * 99, [float("nan")] * 100):
        bad = spark.createDataFrame([(0, x, 0)], "id long, x array<double>, y int")
        with pytest.raises(Exception):
            tr.transform(bad, fitted.bank).collect()
        with pytest.raises(Exception):
            src.checked(bad, 100).collect()


def test_long_runs():
    hit = np.array([[1, 1, 0, 1, 1, 1], [0, 0, 0, 0, 0, 0], [1, 1, 1, 1, 1, 1]], bool)
    assert tr.longest_runs(hit).tolist() == [3, 0, 6]


def test_oversample(spark, bumps):
    s = bumps.where("y <> 1 OR id % 5 = 0")
    n = {r.y: r["count"] for r in tr.oversample(s).groupBy("y").count().collect()}
    assert len(set(n.values())) == 1
    assert tr.oversample(s).select("id").distinct().count() == s.count()


# -- ridge -------------------------------------------------------------------


@pytest.mark.parametrize("n,p", [(30, 200), (60, 8)])
def test_ridge_leave_one_out(n, p):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(n, p)), rng.normal(size=(n, 2))
    alphas = [0.1, 10.0, 1000.0]
    r = ridge.fit(x, y, alphas)
    mean, scale = ridge.standardise(x)
    z = (x - mean) / scale
    for a, loo in zip(alphas, r.loo):
        errors = []
        for i in range(n):
            m = np.arange(n) != i
            zi, yi = z[m], y[m]
            c = np.linalg.solve((zi - zi.mean(0)).T @ (zi - zi.mean(0)) + a * np.eye(p), (zi - zi.mean(0)).T @ (yi - yi.mean(0)))
            errors.append((y[i] - yi.mean(0) - (z[i] - zi.mean(0)) @ c) ** 2)
        assert np.isclose(np.mean(errors), loo, rtol=1e-6)


def test_primal_equals_dual(spark, monkeypatch):
    s = synthetic.bumps(spark, 900, 24, centers=(6, 12, 18))
    bank = tr.fit_bank(s, 84, 1)
    a = model._fit(s, bank, [0, 1, 2], [1.0, 100.0])
    monkeypatch.setattr(model, "DUAL_ROWS", 0)
    b = model._fit(s, bank, [0, 1, 2], [1.0, 100.0])
    monkeypatch.setattr(model, "PASS_BYTES", 8 * 200 * bank.plan.width)  # several passes, several blocks
    monkeypatch.setattr(model, "BLOCK_BYTES", 8 * 37 * bank.plan.width)
    c = model._fit(s, bank, [0, 1, 2], [1.0, 100.0])
    assert c.alpha == b.alpha and np.allclose(b.coef, c.coef, atol=1e-9)
    assert a.alpha == b.alpha and np.allclose(a.loo, b.loo, rtol=1e-3) and np.allclose(a.coef, b.coef, atol=1e-3)


# -- estimators --------------------------------------------------------------


def test_fit_and_predict(spark, fitted, test_bumps):
    p = model.predict(test_bumps, fitted)
    m = metrics.classification(p).first()
    assert m.accuracy > 0.70
    assert set(m.asDict()) == {"accuracy", "balanced_accuracy", "f1_macro", "f1_weighted", "mcc", "mutual_info"}
    imp = fitted.importance()
    assert (imp >= 0).all() and imp.max() == 1
    top = [r.importance for r in ranking.top_features(model.importance_df(spark, fitted), 15).collect()]
    assert top == sorted(top, reverse=True)
    assert fitted.importance([1, 2, 10**9])[3:].sum() == 0


def test_two_classes_and_strings(spark):
    s = synthetic.single_bump(spark, 80, 60, 30, 12, 6.0).withColumn("y", F.when(F.col("y") == 1, "b").otherwise("a"))
    m = model.fit_classifier(s, num_features=84)
    d = model.decision(s, m).collect()
    assert all(len(r.scores) == 1 for r in d) and np.mean([r.pred == r.y for r in d]) > 0.95
    with pytest.raises(ValueError):
        model.fit_classifier(s.where("y = 'a'"), num_features=84)


def test_mask_is_zeroing(spark, fitted, test_bumps):
    mask = list(range(0, 2688, 37))
    f, _ = model.gather(test_bumps.where("id < 5"), fitted.bank)
    f = f.copy()
    f[:, np.setdiff1d(np.arange(2688), mask)] = 0
    want = fitted.ridge.scores(f)
    got = [r.scores for r in model.decision(test_bumps.where("id < 5"), fitted, mask).orderBy("id").collect()]
    assert np.allclose(got, want, atol=1e-6)


def test_regressor(spark):
    s = synthetic.regression(spark, 300)
    m = model.fit_regressor(s.where("id % 4 <> 0"), **SMALL)
    r = metrics.regression(model.predict(s.where("id % 4 = 0"), m)).first()
    assert r.r2 > 0.7 and r.pearson_r > 0.8


def test_cross_validation(spark):
    m, cm = selection.cross_validate(synthetic.bumps(spark, 150), 1, 3, num_features=168)
    rows = m.collect()
    assert len(rows) == 3 and np.mean([r.accuracy for r in rows]) > 0.5
    assert sum(r.n for r in cm.collect()) == 150


def test_elimination(spark, fitted, bumps, test_bumps):
    curve, facts = selection.eliminate(fitted, bumps, test_bumps, 0.4, 6, knee="both")
    rows = curve.orderBy("step").collect()
    assert rows[0].n_features == 2688 and [r.n_features for r in rows] == ranking.elimination_schedule(2688, 0.4, 6)
    assert 0 <= facts["knee"] < len(rows) and len(facts["features"]) == rows[facts["knee"]].n_features
    assert {"knee_kneedle", "knee_threshold"} <= set(facts)


@pytest.mark.parametrize("regress", [False, True])
def test_elimination_without_rows_on_the_driver(spark, monkeypatch, regress):
    s = synthetic.regression(spark, 500, 40) if regress else synthetic.bumps(spark, 500, 24, centers=(6, 12, 18))
    m = (model.fit_regressor if regress else model.fit_classifier)(s, num_features=84, max_dilations=1)
    train, test = s.where("id % 3 <> 0"), s.where("id % 3 = 0")
    a, fa = selection.eliminate(m, train, test, 0.5, 4, [1.0, 100.0])
    f, (_, y) = model.gather(test, m.bank, "y")
    r = ridge.fit(model.gather(train, m.bank, "y")[0][:, fa["kept"][2]], model.encode(model.gather(train, m.bank, "y")[1][1], m.classes), [1.0, 100.0])
    scores = r.scores(f[:, fa["kept"][2]])
    if regress:
        want = 1 - ((np.array(y) - scores[:, 0]) ** 2).sum() / ((np.array(y) - np.mean(y)) ** 2).sum()
    else:
        want = np.mean([m.classes[i] == v for i, v in zip(scores.argmax(1), y)])
    assert a.where("step = 2").first().test_score == pytest.approx(want)
    monkeypatch.setattr(model, "DUAL_ROWS", 0)
    monkeypatch.setattr(model, "gather", None)
    monkeypatch.setattr(model, "SENT_VALUES", 100)
    b, fb = selection.eliminate(m, train, test, 0.5, 4, [1.0, 100.0])
    assert [k.tolist() for k in fa["kept"]] == [k.tolist() for k in fb["kept"]]
    for x, z in zip(a.orderBy("step").collect(), b.orderBy("step").collect()):
        assert x.n_features == z.n_features and x.train_score == pytest.approx(z.train_score, abs=0.01) and x.test_score == pytest.approx(z.test_score, abs=0.01)


def test_information_without_rows_on_the_driver(spark, monkeypatch):
    s = synthetic.bumps(spark, 400, 24, centers=(6, 12, 18))
    m = model.fit_classifier(s, num_features=84, max_dilations=1)
    a = selection.information_decomposition(m, s, range(0, 84, 9), "individual", 10, [1.0]).orderBy("group").collect()
    monkeypatch.setattr(model, "DUAL_ROWS", 0)
    monkeypatch.setattr(model, "gather", None)
    b = selection.information_decomposition(m, s, range(0, 84, 9), "individual", 10, [1.0]).orderBy("group").collect()
    assert [r.group for r in a] == [r.group for r in b]
    assert np.allclose([(r.i_single, r.i_rest, r.i_all) for r in a], [(r.i_single, r.i_rest, r.i_all) for r in b], atol=0.02)


def test_shuffled_confusion():
    """The law of shuffled labels: margins stay, cells have their hypergeometric mean."""
    cm = np.array([[5, 1, 0], [2, 6, 1], [0, 0, 3]])
    rng = np.random.Generator(np.random.PCG64(1))
    drawn = np.array([selection._shuffled(cm, rng) for _ in range(2000)])
    assert (drawn.sum(2) == cm.sum(1)).all() and (drawn.sum(1) == cm.sum(0)).all()
    y = np.repeat([0, 1, 2], cm.sum(1))
    pred = np.concatenate([np.repeat([0, 1, 2], row) for row in cm])
    plain = []
    for _ in range(2000):
        t = np.zeros((3, 3))
        np.add.at(t, (rng.permutation(y), pred), 1)
        plain.append(t)
    assert np.allclose(drawn.mean(0), np.mean(plain, 0), atol=0.15) and np.allclose(drawn.var(0), np.var(plain, 0), atol=0.2)


def test_places_by_bucket(spark):
    """Ranks with nulls, ties and other types of id equal those of one sort."""
    rows = [(i, None if i % 7 == 0 else i % 3, float(i % 5) if i % 11 else None) for i in range(700)]
    s = spark.createDataFrame(rows, "id long, g int, y double")
    got = {r.id: r._r for r in sampling.by_digest(s, ["g"], sampling.digest(1, "t", "id")).collect()}
    import hashlib

    for g in (None, 0, 1, 2):
        ids = sorted((i for i, k, _ in rows if k == g), key=lambda i: (hashlib.md5(f"1:t:{i}".encode()).hexdigest(), i))
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))
    text = s.withColumn("id", F.format_string("n%05d", "id"))
    assert [r._r for r in sampling.by_id(s).orderBy("id").collect()] == list(range(1, 701))
    assert [r._r for r in sampling.by_id(text).orderBy("id").collect()] == list(range(1, 701))
    assert sampling.by_id(s.limit(0)).count() == 0
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0.0, r[0]))
    for n in (1, 6, 699, 700):
        want = [r[0] for k, r in enumerate(order) if k % (700 // n) == 0][:n]
        assert [r.id for r in ranking.spread_by_target(s, n, 700).collect()] == want
    assert ranking.spread_by_target(s.limit(0), 5, 0).count() == 0


def test_threshold_knees():
    assert selection.threshold_knee([0.9, 0.8, 0.895, 0.5]) == 2
    assert selection.threshold_knee([0.9, 0.8, 0.899, 0.5], True) == 0


def test_information(spark, fitted, test_bumps):
    mask = [r[0] for r in ranking.top_features(model.importance_df(spark, fitted), 12).select("feature_index").collect()]
    rows = selection.information_decomposition(fitted, test_bumps, mask, "individual", 10).collect()
    assert len(rows) == 12 and {r.kind for r in rows} <= {"redundant", "synergistic", "independent"}
    with pytest.raises(ValueError):
        selection.feature_groups(model.importance_df(spark, fitted), "other")


def test_mutual_information(spark):
    def mi(pairs):
        return metrics.mutual_information(metrics.confusion(spark.createDataFrame(pairs, "y int, pred int"))).first().mi

    y = [0, 0, 1, 1, 2, 2]
    perfect, scrambled = mi(list(zip(y, y))), mi(list(zip(y, [1, 2, 0, 2, 1, 0])))
    assert perfect == pytest.approx(np.log2(3)) and perfect > scrambled
    assert mi([]) == 0.0


# -- attribution -------------------------------------------------------------


def test_importance_peaks_at_bumps(spark, fitted, test_bumps):
    o = occlusion.aggregate_occlusion(test_bumps.where("id < 40"), fitted).collect()
    by = np.zeros(100)
    for r in o:
        by[r.t] += r["mean"]
    near = np.concatenate([by[c - 10 : c + 11] for c in (25, 50, 75)])
    far = np.concatenate([by[:8], by[93:]])
    assert near.mean() > far.mean()


def test_occlusion_rows(spark, test_bumps):
    assert occlusion.pick_rows(test_bumps, 7).count() == 7
    assert occlusion.pick_rows(test_bumps, 10**6).count() == 100
    assert occlusion.window_defaults(100) == (5, 2) and occlusion.window_defaults(30) == (3, 1)


def test_rank_errors(test_bumps):
    with pytest.raises(ValueError):
        at.class_mean_activation(test_bumps, [Feature(0, "raw", 1, 0, 0.0)], 1)


def test_saliency(spark, fitted, test_bumps):
    truth = spark.range(100).select(F.col("id").cast("int").alias("t"), F.expr("exp(-pow((id % 25) - 0, 2) / 20) * if(id between 15 and 85, 1, 0)").alias("value"))
    maps = truth.withColumn("name", F.lit("truth")).unionByName(saliency.random_saliency(spark, 100).withColumn("name", F.lit("random")))
    drops = saliency.accuracy_drops(test_bumps.where("id < 40"), fitted, maps, (0.1, 0.3), ("zero",))
    assert drops.count() == 4
    assert {r.name for r in saliency.rank(saliency.evaluate(drops)).collect()} == {"truth", "random"}
    with pytest.raises(ValueError):
        saliency.perturb(test_bumps, F.array(F.lit(1)), "other")


def test_shapley_sums_to_gain(spark, fitted, test_bumps):
    v = saliency.shapley_windows(test_bumps.where("id < 2"), fitted, test_bumps.limit(5), window=20, stride=20, permutations=3)
    assert v.count() == 200 and v.where("isnan(v)").count() == 0


def test_shapley_background_is_not_cut(spark, fitted, test_bumps, monkeypatch):
    monkeypatch.setattr(saliency, "MAX_BACKGROUND", 5, raising=False)
    assert saliency.shapley_windows(test_bumps.where("id < 2"), fitted, test_bumps.limit(5), permutations=1).count() > 0
    with pytest.raises(ValueError):
        saliency.shapley_windows(test_bumps.where("id < 2"), fitted, test_bumps.limit(6), permutations=1)


def test_predict_columns(spark, fitted, test_bumps):
    s = test_bumps.where("id < 3")
    c = {r.id: r.value for r in saliency.predict_column(fitted)(s).collect()}
    d = {r.id: max(r.scores) for r in model.decision(s, fitted).collect()}
    assert c == d
    with pytest.raises(ValueError):
        saliency.predict_column(fitted, "target", 17)


# -- channels, spectra -------------------------------------------------------


def test_channels(spark):
    s = synthetic.multichannel(spark, 60)
    assert {r.channel for r in channels.select(s, "top", k=2).collect()} == {1, 4}
    assert {1, 4} <= {r.channel for r in channels.select(s, "elbow", distance="dtw").collect()}
    assert channels.flatten(s, channels.select(s, "top", k=2)).select(F.size("x")).first()[0] == 256
    with pytest.raises(ValueError):
        channels.select(s, "other")


def test_warping():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=9), rng.normal(size=12)
    cost = np.full((10, 13), np.inf)
    cost[0, 0] = 0
    for i in range(9):
        for j in range(12):
            cost[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
    assert channels.warping_distance(a, b) == pytest.approx(np.sqrt(cost[9, 12]))


def test_filter_keeps_its_band(spark):
    t = np.arange(1000) / 250
    x = np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 60 * t)
    df = spark.createDataFrame([(0, 0, [float(v) for v in x])], "channel int, trial long, x array<double>")
    low = np.array(spectral.filtered(df, 250, 0, 20).first().x)
    high = np.array(spectral.filtered(df, 250, 30, 0).first().x)
    assert np.abs(low - np.sin(2 * np.pi * 5 * t))[100:-100].max() < 0.1
    assert np.abs(high - np.sin(2 * np.pi * 60 * t))[100:-100].max() < 0.1
    for bad in ((0, 0), (50, 20), (0, 200)):
        with pytest.raises(ValueError):
            spectral.filtered(df, 250, *bad).collect()
    tfa = spectral.hilbert_tfa(df, 250, 3, 9, 3).collect()
    assert {r.freq_lo for r in tfa} == {3.0, 6.0} and all(r.itc > 0.99 for r in tfa)
    assert np.mean([r.ersp for r in tfa if r.freq_lo == 3.0]) > 0.5


def test_analytic_and_modes():
    t = np.arange(512) / 128
    z = spectral.analytic(np.cos(2 * np.pi * 8 * t)[None, :])[0]
    assert np.allclose(np.abs(z), 1, atol=1e-6)
    modes = spectral.sift(np.sin(2 * np.pi * 20 * t) + np.sin(2 * np.pi * 2 * t), 3)
    assert np.allclose(sum(modes), np.sin(2 * np.pi * 20 * t) + np.sin(2 * np.pi * 2 * t), atol=1e-6) or len(modes) == 3


# -- sampling, generators ----------------------------------------------------


def test_folds(spark, bumps):
    f = sampling.stratified_folds(bumps, 2, 5).groupBy("repeat", "y", "fold").count().collect()
    for r in range(2):
        for y in range(3):
            n = [x["count"] for x in f if x.repeat == r and x.y == y]
            assert max(n) - min(n) <= 1 and len(n) == 5
    p = sampling.permuted_labels(bumps, 2)
    assert p.where("permutation = 0").groupBy("y").count().orderBy("y").collect() == bumps.groupBy("y").count().orderBy("y").collect()


def test_generators(spark):
    b = synthetic.bumps(spark, 300)
    assert b.schema["x"].dataType.simpleString() == "array<float>" and b.select("y").distinct().count() == 3
    with pytest.raises(ValueError):
        synthetic.bumps(spark, 5, amplitudes=(1, 2))
    assert 0 < synthetic.bayes_error(spark, noise_std=1.0).first().error < 0.10
    assert synthetic.bayes_error(spark, noise_std=3.0).first().error > 0.25
    assert 1.2 < synthetic.noise_for_error(spark, 0.15, draws=20_000) < 2.5
    assert synthetic.sample_signals(spark).count() == 3


def test_scores_stream(spark, fitted, test_bumps, tmp_path):
    from chronolens.streaming.score import score_stream

    test_bumps.select("id", "x", "y").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(test_bumps.schema).parquet(str(tmp_path / "in"))
    q = score_stream(stream, fitted).writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").count() == 100
    with pytest.raises(ValueError):
        score_stream(test_bumps, fitted)


@pytest.mark.parametrize("labels", [(False, True), (0.5, 1.5), ("a", "b"), (3, 7)])
def test_predictions_have_the_labels_type(spark, labels):
    rows = synthetic.bumps(spark, 60, seed=1).where("y < 2")
    rows = rows.withColumn("y", F.when(F.col("y") == 0, F.lit(labels[0])).otherwise(F.lit(labels[1])))
    m = model.fit_classifier(rows, num_features=168, max_dilations=8)
    got = [r for r in model.predict(rows, m).collect()]
    assert {type(r["pred"]) for r in got} == {type(labels[0])}
    assert sum(r["pred"] == r["y"] for r in got) > 0.7 * len(got)


def test_calendars_are_parameters(spark, tmp_path):

    d = str(tmp_path)
    spark.sql("SELECT 1L user_id, 'click' event_type, 2.0 value, timestamp '2024-01-02 00:00:00' ts UNION ALL SELECT 1L, 'click', 3.0, timestamp '2024-03-02 00:00:00'").write.parquet(f"{d}/events.parquet")
    spark.sql("SELECT 1L o_custkey, 5.0 o_totalprice, date '1995-02-01' o_orderdate UNION ALL SELECT 2L, 1.0, date '1990-01-01'").write.parquet(f"{d}/orders.parquet")
    assert [tuple(r) for r in src.coverage(spark, d).orderBy("source").collect()] == [("events", 1, 1, 0), ("orders", 1, 1, 0)]
    assert sum(src.events_daily(spark, d).first()["x"]) == 2.0
    assert src.events_daily(spark, d, "2024-03-01", 3).first()["x"] == [0.0, 3.0, 0.0]
    assert src.orders_monthly(spark, d, "1990-01-01", 2).first()["x"] == [1.0, 0.0]


def test_matched_spectrum(spark):
    rng = np.random.default_rng(4)
    trials = spark.createDataFrame([(i, rng.normal(size=40).cumsum().tolist()) for i in range(30)] + [(30, [0.0] * 40)], "trial long, x array<double>")
    modes = spectral.decompose(trials, 80.0, 3).withColumn("condition", (F.col("trial") % 2).cast("int")).cache()
    picks = sampling.match_trials(trials.select(F.col("trial").alias("id"), (F.col("trial") % 2).cast("int").alias("condition")), "condition", 3, 0.9).cache()
    want = spectral.marginal_spectrum(spectral.matched(modes, picks, "condition"), 0, 30, 20, "condition", "rep")
    got = spectral.matched_spectrum(modes, picks, "condition", 0, 30, 20)
    assert got.schema.simpleString() == want.schema.simpleString()
    a, b = (sorted(map(tuple, t.collect())) for t in (got, want))
    assert [r[:3] for r in a] == [r[:3] for r in b] and len(a) > 60
    np.testing.assert_allclose([r[3] for r in a], [r[3] for r in b], rtol=1e-9)


def test_modes_stay_off_the_driver(spark, tmp_path):
    """One decomposition, and no broadcast of what an Arrow stage makes, however small it is thought to be."""
    from chronolens.plans import QUERIES

    spark.sql("SELECT id % 7 o_custkey, 5.0 + id o_totalprice, date_add(date '1995-02-01', cast(id as int)) o_orderdate FROM range(300)").write.parquet(f"{tmp_path}/orders.parquet")
    plan = QUERIES["matched_mode_spectrum"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    join = spectral.matched(spark.range(5).selectExpr("id trial", "0 c"), spark.range(5).selectExpr("id", "0 c", "0 rep"), "c")
    plan = join._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

"""Cross-validation, stability, elimination, permutation tests, information.

Loops over folds, steps and permutations run on the driver; each round is a Spark
job or an algebraic update.  Features are computed once wherever labels alone
change from round to round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import full_grid, of_confusion, regression
from .model import Model, Refits, fit_classifier, fit_regressor, predict, tallies
from .ranking import elimination_schedule
from .sampling import plain_folds, stratified_folds


def _fit(series: DataFrame, regression_: bool, **config) -> Model:
    return fit_regressor(series, **config) if regression_ else fit_classifier(series, **config)


def cross_validate(series: DataFrame, repeats: int = 10, folds: int = 10, seed: int = 42, is_regression: bool = False, **config) -> tuple[DataFrame, DataFrame | None]:
    """(metrics by repeat and fold, summed confusion).  Each fold is fitted anew,
    biases included; each test row is predicted once, and of a fold only its counts
    (or its metrics, for numbers) stay."""
    parts = plain_folds(series, repeats, folds, seed) if is_regression else stratified_folds(series, repeats, folds, seed)
    parts = parts.select("id", "repeat", "fold").persist()
    spark, rows, schema = series.sparkSession, [], None
    for r in range(repeats):
        for k in range(folds):
            here = parts.where((F.col("repeat") == r) & (F.col("fold") == k)).select("id")
            train = series.join(here, "id", "left_anti")
            test = series.join(here, "id", "left_semi")
            p = predict(test, _fit(train, is_regression, **config)).select(F.lit(r).alias("repeat"), F.lit(k).alias("fold"), "y", "pred")
            if is_regression:
                found = regression(p, "repeat", "fold")
            else:
                found = p.groupBy("repeat", "fold", "y", "pred").agg(F.count("*").alias("n"))
            rows += found.collect()  # classes squared, or one row
            schema = found.schema
    parts.unpersist()
    if is_regression:
        return spark.createDataFrame(rows, schema), None
    counts = spark.createDataFrame(rows, schema)
    total = counts.groupBy("y", "pred").agg(F.sum("n").alias("n"))
    return of_confusion(full_grid(counts, "repeat", "fold"), "repeat", "fold"), full_grid(total)


def fold_importance(series: DataFrame, repeats: int = 5, folds: int = 5, n_top: int = 50, seed: int = 42, is_regression: bool = False, **config) -> DataFrame:
    """(repeat, fold, feature_index, importance) of each fold's top features."""
    spark = series.sparkSession
    parts = (plain_folds if is_regression else stratified_folds)(series, repeats, folds, seed).select("id", "repeat", "fold").persist()
    rows = []
    for r in range(repeats):
        for k in range(folds):
            here = parts.where((F.col("repeat") == r) & (F.col("fold") == k)).select("id")
            imp = _fit(series.join(here, "id", "left_anti"), is_regression, **config).importance()
            order = np.lexsort((np.arange(len(imp)), -imp))[:n_top]
            rows += [(r, k, int(i), float(imp[i])) for i in order]
    parts.unpersist()
    return spark.createDataFrame(rows, "repeat int, fold int, feature_index int, importance double")


def stability(tops: DataFrame) -> DataFrame:
    """(feature_index, count, fraction): folds in which a feature is on top."""
    folds = tops.select("repeat", "fold").distinct().count()
    return tops.groupBy("feature_index").agg(F.count("*").alias("count")).withColumn("fraction", F.col("count") / folds)


def stable_features(counts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Features at or above the threshold, most stable first."""
    return counts.where(F.col("fraction") >= threshold - 1e-12).orderBy(F.desc("count"), "feature_index")


def presence(tops: DataFrame, chosen: DataFrame) -> DataFrame:
    """(feature_index, repeat, fold, present) of chosen features in all folds."""
    folds = tops.select("repeat", "fold").distinct()
    grid = chosen.select("feature_index").crossJoin(folds)  # tens of features times folds
    hit = tops.select("feature_index", "repeat", "fold", F.lit(1).alias("p"))
    return grid.join(hit, ["feature_index", "repeat", "fold"], "left").select("feature_index", "repeat", "fold", F.coalesce("p", F.lit(0)).alias("present"))


def threshold_knee(scores: list[float], is_regression: bool = False) -> int:
    """Last step near the best: within 0.01 anywhere (classification), or within
    1 percent of the best in the unbroken run from the best on (regression)."""
    best = int(np.argmax(scores))
    if not is_regression:
        return max(i for i, s in enumerate(scores) if s >= max(scores) - 0.01)
    limit = max(scores) - 0.01 * abs(max(scores))
    knee = best
    for i in range(best, len(scores)):
        if scores[i] < limit:
            break
        knee = i
    return knee


def kneedle_index(values) -> int:
    v = np.asarray(values, float)
    if len(v) < 3:
        return 0
    u = (v - v.min()) / (v.max() - v.min() + 1e-15)
    chord = np.linspace(u[0], u[-1], len(u))
    return int(np.argmax(np.round(np.abs(u - chord), 12)))


def eliminate(model: Model, train: DataFrame, test: DataFrame, drop: float = 0.05, steps: int = 150, alphas=None, knee: str = "kneedle") -> tuple[DataFrame, dict]:
    """Recursive elimination: ((step, n_features, train_score, test_score), facts).

    Each step keeps the most important features and refits on those columns of one
    table of features, or beyond its bound of one matrix of cross products; all
    steps are scored together.
    """
    if knee not in ("kneedle", "threshold", "both"):
        raise ValueError("knee is 'kneedle', 'threshold' or 'both'")
    reg = model.classes is None
    refits = Refits(train, model.bank, model.classes)

    def scores_of(series, fits):
        found = tallies(series, model.bank, model.classes, fits)
        if reg:
            return [float(1 - e / (q - a * a / n)) if n and q > a * a / n else float("nan") for n, a, q, e in found]
        return [float(np.trace(t) / t.sum()) if t.sum() else float("nan") for t in found]

    keep = np.arange(model.width)
    imp = model.importance()
    first = np.lexsort((np.arange(len(imp)), -imp))
    kept, fits = [], []
    for step, m in enumerate(elimination_schedule(model.width, drop, steps)):
        order = np.lexsort((keep, -imp[: len(keep)] if step else -imp[keep]))
        keep = np.sort(keep[order[:m]])
        r = refits.fit(keep, alphas)
        imp = np.sqrt((r.coef**2).sum(0))
        fits.append((keep, r))
        kept.append(keep)
    rows = [(i, len(k), a, b) for i, (k, a, b) in enumerate(zip(kept, scores_of(train, fits), scores_of(test, fits)))]
    scores = [r[3] for r in rows]
    at = {"kneedle": kneedle_index(scores), "threshold": threshold_knee(scores, reg)}
    facts = {"knee": at["kneedle" if knee == "both" else knee], "kept": kept, "full_ranking": first.tolist(), "full_score": model.classes and scores[0]}
    if knee == "both":
        facts |= {"knee_kneedle": at["kneedle"], "knee_threshold": at["threshold"]}
    facts["features"] = kept[facts["knee"]].tolist()
    return train.sparkSession.createDataFrame(rows, "step int, n_features int, train_score double, test_score double"), facts


def permutation_p(observed: DataFrame, null: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(feature_index, p_value, null_p95, significant): share of null importances
    that reach the observed one; features outside of the mask have p = 1."""
    n = null.join(observed.select("feature_index", F.col("importance").alias("_o")), "feature_index")
    p = n.groupBy("feature_index").agg(
        F.avg((F.col("importance") >= F.col("_o")).cast("double")).alias("p_value"), F.percentile("importance", 0.95).alias("null_p95")
    )
    out = observed.select("feature_index").join(p, "feature_index", "left")
    if mask is not None:
        out = out.join(mask.select("feature_index", F.lit(1).alias("_m")), "feature_index", "left")
        out = out.withColumn("p_value", F.when(F.col("_m").isNotNull(), F.col("p_value"))).drop("_m")
    out = out.withColumn("p_value", F.coalesce("p_value", F.lit(1.0)))
    return out.withColumn("significant", F.col("p_value") < 0.05)


def permutation_importance(model: Model, series: DataFrame, permutations: int = 100, estimator=None, mask=None, seed: int = 42) -> DataFrame:
    """Permutation test of a forest's importances on standardised features.

    ``estimator``: a pyspark.ml classifier whose model has featureImportances or
    coefficientMatrix.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    from .sampling import permuted_labels
    from .transform import transform

    spark = series.sparkSession
    feats = transform(series.select("id", "x", "y"), model.bank)
    classes = {c: i for i, c in enumerate(model.classes)}
    label = F.coalesce(*[F.when(F.col("y") == c, F.lit(float(i))) for c, i in classes.items()])
    feats = feats.select("id", "y", array_to_vector(F.col("features").cast("array<double>")).alias("features")).persist()
    est = estimator or RandomForestClassifier(numTrees=100, maxDepth=8, seed=seed)
    est = est.copy({est.featuresCol: "features", est.labelCol: "label"})

    def importances(rows: DataFrame) -> np.ndarray:
        m = est.fit(rows.select("features", label.alias("label")))
        if hasattr(m, "featureImportances"):
            return m.featureImportances.toArray()
        if hasattr(m, "coefficientMatrix"):
            return np.sqrt((m.coefficientMatrix.toArray() ** 2).sum(0))
        raise ValueError("the estimator's model has no importances")

    observed = importances(feats)
    top = observed.max() or 1.0
    shuffled = permuted_labels(feats.select("id", "y"), permutations, seed).persist()
    null = []
    for k in range(permutations):
        y = shuffled.where(F.col("permutation") == k).select("id", F.col("y").alias("_y"))
        imp = importances(feats.join(y, "id").withColumn("y", F.col("_y")))
        null += [(k, i, float(v / top)) for i, v in enumerate(imp)]
    obs = spark.createDataFrame([(i, float(v / top)) for i, v in enumerate(observed)], "feature_index int, importance double")
    nul = spark.createDataFrame(null, "permutation int, feature_index int, importance double")
    m = None if mask is None else spark.createDataFrame([(int(i),) for i in mask], "feature_index int")
    return permutation_p(obs, nul, m)


def feature_groups(dim: DataFrame, by: str = "kernel") -> DataFrame:
    """(group, position): places in the mask (in order of index) of each group."""
    keys = {"individual": ["position"], "kernel": ["kernel_index"], "kernel_dilation": ["kernel_index", "dilation"]}
    if by not in keys:
        raise ValueError(f"group by one of {sorted(keys)}")
    w = Window.orderBy("feature_index")  # a row for each chosen feature
    d = dim.withColumn("position", F.row_number().over(w) - 1)
    name = {"individual": F.format_string("F%d", "position"), "kernel": F.format_string("K%d", "kernel_index"), "kernel_dilation": F.format_string("K%d-d%d", "kernel_index", "dilation")}[by]
    return d.select(name.alias("group"), "position", "feature_index")


def classify_information(groups: DataFrame, threshold: float) -> DataFrame:
    """(…, contribution, p, kind) from (group, i_single, i_rest, i_all)."""
    c = F.col("i_all") - F.col("i_rest")
    p = c - F.col("i_single")
    kind = F.when(p < -threshold, "redundant").when(p > threshold, "synergistic").otherwise("independent")
    return groups.withColumn("contribution", c).withColumn("p", p).withColumn("kind", kind)


def _mi(cm: np.ndarray) -> float:
    """Bits of mutual information of a confusion table."""
    p = cm / max(1.0, cm.sum())
    r, c = p.sum(1, keepdims=True), p.sum(0, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(p > 0, p * np.log2(p / (r * c)), 0.0)
    return float(t.sum())


def _shuffled(cm: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A confusion table as it is after shuffling the labels: labels dealt to
    predictions without replacement, so the margins decide its law."""
    left, out = cm.sum(1).astype(np.int64), np.zeros_like(cm)
    for j, n in enumerate(cm.sum(0).astype(np.int64)):
        out[:, j] = _dealt(left, int(n), rng)
        left = left - out[:, j].astype(np.int64)
    return out


def _dealt(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of n draws without replacement come from each class."""
    out, rest = np.zeros(len(counts), np.int64), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        rest -= c
        out[i] = rng.hypergeometric(c, rest, n) if n else 0
        n -= int(out[i])
    return out


def information_decomposition(model: Model, test: DataFrame, mask=None, by: str = "kernel", shuffles: int = 100, alphas=None, seed: int = 42) -> DataFrame:
    """(group, i_single, i_rest, i_all, contribution, p, kind).

    Group models are refitted on the test rows' masked features; the whole is the
    model's own prediction.  Rows meet in counts only, the shuffled ones too.
    """
    from .model import importance_df

    spark = test.sparkSession
    mask = np.arange(model.width) if mask is None else np.array(sorted(int(m) for m in mask))
    dim = importance_df(spark, model).where(F.col("feature_index").isin(mask.tolist())) if len(mask) < model.width else importance_df(spark, model)
    groups: dict[str, list[int]] = {}
    for g, p in feature_groups(dim, by).select("group", "position").orderBy("position").collect():  # the mask's rows
        groups.setdefault(g, []).append(p)

    whole = tallies(test, model.bank, model.classes, [(None, model.ridge)])[0]
    rng = np.random.Generator(np.random.PCG64(seed))
    null = [_mi(_shuffled(whole, rng)) for _ in range(shuffles)]
    limit = float(np.mean(null) + 2 * np.std(null))

    refits = Refits(test, model.bank, model.classes)
    fits, at = [], {}
    for g, places in sorted(groups.items()):
        rest = np.setdiff1d(np.arange(len(mask)), places)
        at[g] = len(fits), len(fits) + 1 if len(rest) else None
        fits += [(mask[p], refits.fit(mask[p], alphas)) for p in (places, rest) if len(p)]
    told = [_mi(t) for t in tallies(test, model.bank, model.classes, fits)]
    rows = [(g, told[one], 0.0 if rest is None else told[rest], _mi(whole)) for g, (one, rest) in at.items()]
    return classify_information(spark.createDataFrame(rows, "group string, i_single double, i_rest double, i_all double"), limit)


def signed_rank(pairs: DataFrame) -> DataFrame:
    """(n, w_plus, w_minus, z) of Wilcoxon's signed-rank test over (a, b)."""
    d = pairs.select((F.col("a") - F.col("b")).alias("d")).where("d <> 0")
    w = Window.orderBy(F.abs("d"))  # a row for each benchmark round
    same = Window.partitionBy(F.abs("d"))
    r = d.withColumn("_r", F.rank().over(w) + (F.count("*").over(same) - 1) / 2)
    s = r.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("_r"))), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("_r"))), F.lit(0.0)).alias("w_minus"),
    )
    n = F.col("n")
    return s.withColumn("z", F.when(n > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).otherwise(0.0))



"""Estimators: the kernel bank followed by ridge.

A fitted model is a bundle of arrays; predicting is one narrow stage in which
features never leave the worker.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chronolens.functions.plan import feature_dim

from . import ridge
from .transform import Bank, bound_batches, fit_bank, map_features, oversample

#: Rows times features up to which rows are gathered for the dual form.
DUAL_VALUES = 200_000_000
#: Rows above which the primal form is used even if features are more.
DUAL_ROWS = 5000


@dataclass(frozen=True)
class Model:
    bank: Bank
    ridge: ridge.Ridge
    classes: list | None = None  # None: regression
    config: dict = field(default_factory=dict)

    @property
    def width(self) -> int:
        return self.bank.plan.width

    def importance(self, mask=None) -> np.ndarray:
        """L2 norm of each feature's coefficients, as a share of the largest;
        outside of ``mask`` 0."""
        norm = np.sqrt((self.ridge.coef**2).sum(0))
        if mask is not None:
            keep = np.zeros(len(norm), bool)
            keep[[m for m in mask if m < len(norm)]] = True
            norm = np.where(keep, norm, 0.0)
        top = norm.max()
        return norm / top if top > 0 else norm

    def needed(self, mask=None) -> set[int] | None:
        return None if mask is None else {int(m) // 4 for m in mask}


def _target(batch: pa.RecordBatch, classes) -> np.ndarray:
    y = batch.column(batch.schema.get_field_index("y"))
    if classes is None:
        return np.asarray(y.to_numpy(zero_copy_only=False), np.float64)[:, None]
    at = {c: i for i, c in enumerate(classes)}
    index = np.array([at[v] for v in y.to_pylist()])
    if len(classes) == 2:
        return np.where(index == 1, 1.0, -1.0)[:, None]
    return np.where(np.arange(len(classes))[None, :] == index[:, None], 1.0, -1.0)


#: Bytes of cross products that a task holds in one pass over the rows.
PASS_BYTES = 256 << 20
#: Bytes of one block of rows of the matrix on its way.
BLOCK_BYTES = 1 << 20


def _moments(series: DataFrame, bank: Bank, classes, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sums, cross products), added up in tasks, then by blocks of rows
    of the matrix.

    A pass makes as many rows of the matrix as PASS_BYTES hold; making features
    again costs little beside their products.  As each task sends its share of the
    matrix, there are no more than two tasks a core.
    """
    context = series.sparkSession.sparkContext
    bound_batches(series.sparkSession, 4 * BLOCK_BYTES)
    p = bank.plan.width
    rows = max(1, PASS_BYTES // (8 * p))
    few = series.select("x", "y").coalesce(2 * context.defaultParallelism)
    sent = context.broadcast((bank.plan, bank.biases))
    n, s, g = 0, np.zeros(p + k), np.zeros((p + k, p))
    for lo in range(0, p + k, rows):
        for r in _moments_pass(few, sent, classes, p, k, lo, lo + rows).toLocalIterator():
            n = r["n"]
            part = np.frombuffer(r["s"])
            s[r["b"] : r["b"] + len(part)] = part
            g[r["b"] : r["b"] + len(part)] = np.frombuffer(r["g"]).reshape(len(part), p)
    return n, s, g


def _moments_pass(series: DataFrame, sent, classes, p: int, k: int, lo: int, hi: int) -> DataFrame:
    size = max(1, BLOCK_BYTES // (8 * p))

    def run(batches):
        from .transform import STEP_VALUES, _rows, bank_features

        plan, biases = sent.value
        step = max(1, STEP_VALUES // plan.width)
        m = ridge.Moments(p, k, lo, hi)
        for batch in batches:
            for j in range(0, batch.num_rows, step):
                part = batch.slice(j, step)
                m.add(bank_features(_rows(part.column(part.schema.get_field_index("x")), plan.length), plan, biases), _target(part, classes))
        if m.n:
            for b in range(0, m.hi - m.lo, size):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lo + b], pa.int32()), pa.array([m.n], pa.int64()), pa.array([m.s[b : b + size].tobytes()]), pa.array([m.g[b : b + size].tobytes()])], names=["b", "n", "s", "g"]
                )

    def add(batches):
        held: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                b, n, s, g = (c[i].as_py() for c in batch.columns)
                h = held.setdefault(b, [0, 0.0, 0.0])
                h[0] += n
                h[1] = h[1] + np.frombuffer(s)
                h[2] = h[2] + np.frombuffer(g)
        for b, (n, s, g) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([n], pa.int64()), pa.array([s.tobytes()]), pa.array([g.tobytes()])], names=["b", "n", "s", "g"])

    schema = "b int, n long, s binary, g binary"
    return series.mapInArrow(run, schema).repartition(F.col("b")).mapInArrow(add, schema)


def _loo_pass(series: DataFrame, bank: Bank, classes, keep=None):
    """Leave-one-out errors from rows, on all features or those of ``keep``."""

    def errors(n, mean, scale, ybar, v, w, rotated, alphas):
        sent = series.sparkSession.sparkContext.broadcast((n, mean, scale, ybar, v, w, rotated, alphas))
        schema = T.StructType([T.StructField("e", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])

        def score(f, part):
            n, mean, scale, ybar, v, w, rotated, alphas = sent.value
            y = _target(part, classes)
            f = f if keep is None else f[:, keep]
            zv = ((f - mean) / scale) @ v
            out = []
            for a in alphas:
                h = np.minimum(1 - 1e-10, 1.0 / n + (zv * zv) @ (1 / (w + a)))
                out.append(float((((y - ybar - zv @ (rotated / (w + a)[:, None])) / (1 - h)[:, None]) ** 2).sum()))
            return [pa.array([out], pa.list_(pa.float64())), pa.array([y.size], pa.int64())]

        rows = map_features(series.select("x", "y"), bank, score, schema, None if keep is None else {int(i) // 4 for i in keep})
        sums = rows.select(F.posexplode("e").alias("a", "e"), "n").groupBy("a").agg((F.sum("e") / F.sum("n")).alias("e"))
        found = {r["a"]: r["e"] for r in sums.collect()}  # one row for each penalty
        return np.array([found[i] for i in range(len(alphas))])

    return errors


def gather(series: DataFrame, bank: Bank, *columns: str) -> tuple[np.ndarray, list[list]]:
    """Features (rows by id) and the given columns of rows that the caller has
    counted and found to be few."""
    from .transform import transform

    table = transform(series.select("id", "x", *columns), bank).orderBy("id").toArrow()
    flat = table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1), [table.column(c).to_pylist() for c in ("id", *columns)]


def encode(y: list, classes) -> np.ndarray:
    batch = pa.RecordBatch.from_arrays([pa.array(y)], names=["y"])
    return _target(batch, classes)


class Refits:
    """Ridge on any columns of one table's features.

    Up to DUAL_ROWS rows their features are held here.  Beyond, tasks add up
    moments and cross products once, every refit takes a part of that matrix, and
    one pass over the rows gives its leave-one-out errors; no row comes here.
    """

    def __init__(self, series: DataFrame, bank: Bank, classes):
        self.series, self.bank, self.classes = series, bank, classes
        rows = series.count()
        self.held = rows <= DUAL_ROWS and rows * bank.plan.width <= DUAL_VALUES
        if self.held:
            self.f, (_, y) = gather(series, bank, "y")
            self.t = encode(y, classes)
        else:
            self.k = 1 if classes is None or len(classes) == 2 else len(classes)
            self.n, self.s, self.g = _moments(series, bank, classes, self.k)

    def fit(self, keep=None, alphas=None) -> ridge.Ridge:
        """Ridge on the columns ``keep`` in their order; None: on all."""
        if self.held:
            return ridge.fit(self.f if keep is None else self.f[:, keep], self.t, alphas)
        if keep is None:
            return ridge.fit_moments(self.n, self.s, self.g, alphas, _loo_pass(self.series, self.bank, self.classes))
        keep = np.asarray(keep, int)
        at = np.concatenate([keep, self.bank.plan.width + np.arange(self.k)])
        return ridge.fit_moments(self.n, self.s[at], self.g[np.ix_(at, keep)], alphas, _loo_pass(self.series, self.bank, self.classes, keep))


def _fit(series: DataFrame, bank: Bank, classes, alphas) -> ridge.Ridge:
    return Refits(series, bank, classes).fit(None, alphas)


#: Coefficients that one pass of ``tallies`` sends to tasks.
SENT_VALUES = 4_000_000


def tallies(series: DataFrame, bank: Bank, classes, fits: list[tuple]) -> np.ndarray:
    """What rows say of each fit, (columns or None, ridge): counts by label and
    prediction (fits x classes x classes), or for numbers, about the fit's mean,
    (rows, sum, sum of squares, squared errors).

    Sums are made in tasks and added up by fit; one pass serves as many fits as
    SENT_VALUES coefficients allow.
    """
    out, block, size = [], [], 0
    for keep, r in fits:
        if block and size + r.coef.size > SENT_VALUES:
            out.append(_tally(series, bank, classes, block))
            block, size = [], 0
        block.append((keep, r))
        size += r.coef.size
    out.append(_tally(series, bank, classes, block))
    return np.concatenate(out)


def _tally(series: DataFrame, bank: Bank, classes, fits: list[tuple]) -> np.ndarray:
    sent = series.sparkSession.sparkContext.broadcast(fits)
    c = 0 if classes is None else len(classes)
    schema = T.StructType([T.StructField("v", T.ArrayType(T.DoubleType()))])

    def score(f, part):
        t = _target(part, classes)
        y = t[:, 0] if classes is None else (t[:, 0] > 0).astype(int) if c == 2 else t.argmax(1)
        values = []
        for keep, r in sent.value:
            s = r.scores(f if keep is None else f[:, keep])
            if classes is None:
                away = y - r.intercept[0]
                values += [len(y), away.sum(), (away**2).sum(), ((y - s[:, 0]) ** 2).sum()]
            else:
                pred = (s[:, 0] > 0).astype(int) if c == 2 else s.argmax(1)
                values += np.bincount(y * c + pred, minlength=c * c).tolist()
        return [pa.array([[float(v) for v in values]], pa.list_(pa.float64()))]

    needed = None if any(keep is None for keep, _ in fits) else {int(i) // 4 for keep, _ in fits for i in keep}
    rows = map_features(series.select("x", "y"), bank, score, schema, needed)
    shape = (4,) if classes is None else (c, c)
    out = np.zeros(len(fits) * int(np.prod(shape)))
    for i, v in rows.select(F.posexplode("v")).groupBy("pos").agg(F.sum("col")).collect():  # a row for each fit and cell
        out[i] = v
    return out.reshape(len(fits), *shape)


def fit_classifier(
    series: DataFrame,
    max_dilations: int = 16,
    num_features: int = 10000,
    seed: int = 0,
    alphas=None,
    class_weight: str | None = None,
) -> Model:
    """Kernel bank and ridge on one-against-rest targets."""
    if class_weight not in (None, "balanced"):
        raise ValueError("class_weight is None or 'balanced'")
    if class_weight == "balanced":
        series = oversample(series, seed)
    classes = [r[0] for r in series.select("y").distinct().orderBy("y").collect()]
    if len(classes) < 2:
        raise ValueError("fewer than two classes")
    bank = fit_bank(series, num_features, max_dilations, seed)
    config = dict(max_dilations=max_dilations, num_features=num_features, seed=seed, alphas=alphas, class_weight=class_weight)
    return Model(bank, _fit(series, bank, classes, alphas), classes, config)


def fit_regressor(series: DataFrame, max_dilations: int = 16, num_features: int = 10000, seed: int = 0, alphas=None) -> Model:
    bank = fit_bank(series, num_features, max_dilations, seed)
    config = dict(max_dilations=max_dilations, num_features=num_features, seed=seed, alphas=alphas)
    return Model(bank, _fit(series, bank, None, alphas), None, config)


def restrict(model: Model, mask) -> Model:
    """The model with coefficients of the masked features only.

    Zeroing a raw feature before scaling adds a constant to the scores; that
    constant is kept, so scores equal those of zeroed features.
    """
    if mask is None:
        return model
    r = model.ridge
    keep = np.zeros(model.width, bool)
    keep[list(mask)] = True
    shift = (r.coef[:, ~keep] * (-r.mean[~keep] / r.scale[~keep])).sum(1)
    return replace(model, ridge=replace(r, coef=np.where(keep, r.coef, 0.0), intercept=r.intercept + shift))


def label_type(classes) -> T.DataType:
    """The type of predictions: that of the labels."""
    if all(isinstance(c, (bool, np.bool_)) for c in classes):
        return T.BooleanType()
    if all(isinstance(c, (int, np.integer)) for c in classes):
        return T.LongType()
    return T.StringType() if all(isinstance(c, str) for c in classes) else T.DoubleType()


def decision(series: DataFrame, model: Model, mask=None) -> DataFrame:
    """Columns but x, ``scores`` (one a class; one for two classes or regression)
    and ``pred``."""
    model = restrict(model, mask)
    carried = [f for f in series.schema.fields if f.name not in ("x", "scores", "pred")]
    classes = model.classes
    kind = T.DoubleType() if classes is None else label_type(classes)
    arrow = to_arrow_type(kind)
    schema = T.StructType([*carried, T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("pred", kind)])
    r = series.sparkSession.sparkContext.broadcast(model.ridge)

    def score(f, part):
        s = r.value.scores(f)
        if classes is None:
            pred = pa.array(s[:, 0], pa.float64())
        else:
            index = (s[:, 0] > 0).astype(int) if len(classes) == 2 else s.argmax(1)
            pred = pa.array([classes[i] for i in index], arrow)
        return [*[part.column(part.schema.get_field_index(c.name)) for c in carried], pa.array(list(s), pa.list_(pa.float64())), pred]

    return map_features(series, model.bank, score, schema, model.needed(mask))


def predict(series: DataFrame, model: Model) -> DataFrame:
    return decision(series, model).drop("scores")


def importance_df(spark, model: Model, mask=None) -> DataFrame:
    """The feature dimension with importance."""
    imp = model.importance(mask)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(imp)], "feature_index int, importance double")
    return feature_dim(spark, model.bank.plan, list(model.bank.biases)).join(rows, "feature_index")


def summary(spark, model: Model, n_top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(key, value) facts of a model, and its top features."""
    from .ranking import top_features

    facts = [("length", str(model.bank.plan.length)), ("features", str(model.width)), ("alpha", repr(model.ridge.alpha))]
    for rep, n, d, b in model.bank.plan.parts():
        facts += [(f"{rep}_dilations", str(d)), (f"{rep}_biases", str(84 * sum(b)))]
    facts.append(("classes", "regression" if model.classes is None else str(model.classes)))
    return spark.createDataFrame(facts, "key string, value string"), top_features(importance_df(spark, model), n_top)

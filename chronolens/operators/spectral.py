"""Filtering and time-frequency summaries of trials (channel, trial, x).

Filters and analytic signals are computed a trial at a time in narrow Arrow
stages; everything across trials is aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# -- filters -----------------------------------------------------------------


def fir_lowpass(order: int, cut: float) -> np.ndarray:
    """Hamming-windowed sinc of ``order`` + 1 taps; cut as a share of Nyquist."""
    n = np.arange(order + 1) - order / 2
    h = np.sinc(cut * n) * cut * np.hamming(order + 1)
    return h / h.sum()


def fir(order: int, low: float, high: float, srate: float, notch: bool = False) -> np.ndarray:
    """Taps of a low-, high-, band-pass or (``notch``) band-stop filter."""
    nyquist = srate / 2
    if low and high:
        h = fir_lowpass(order, high / nyquist) - fir_lowpass(order, low / nyquist)
        if notch:
            h = -h
            h[order // 2] += 1
        else:
            w = np.exp(-1j * np.pi * (low + high) / 2 / nyquist * np.arange(order + 1))
            h = h / abs((h * w).sum())
        return h
    if high:
        return fir_lowpass(order, high / nyquist)
    h = -fir_lowpass(order, low / nyquist)
    h[order // 2] += 1
    return h


def filter_order(srate: float, low: float, high: float, order: int = 0) -> int:
    """Three cycles of the lowest cut, 15 at least, even."""
    if not order:
        order = max(15, 3 * int(srate / (low or high)))
    return order + order % 2


def check_filter(srate: float, low: float, high: float, epoch: int, order: int) -> None:
    nyquist = srate / 2
    if low and high and low > high:
        raise ValueError("the low cut is above the high cut")
    if low < 0 or high < 0 or not (low or high):
        raise ValueError("a cut must be positive")
    if low > nyquist or high > nyquist:
        raise ValueError("a cut is above the Nyquist frequency")
    if epoch <= 3 * order:
        raise ValueError("epochs are shorter than three times the filter order")


def forward_backward(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Zero-phase filtering of rows, with odd reflections at both ends."""
    n = min(3 * len(h), x.shape[1] - 1)
    left, right = 2 * x[:, :1] - x[:, n:0:-1], 2 * x[:, -1:] - x[:, -2 : -n - 2 : -1]
    y = np.concatenate([left, x, right], 1)
    for _ in range(2):
        size = y.shape[1] + len(h) - 1
        y = np.fft.irfft(np.fft.rfft(y, size) * np.fft.rfft(h, size), size)[:, : y.shape[1]][:, ::-1]
    return y[:, n : n + x.shape[1]]


def forward(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    size = x.shape[1] + len(h) - 1
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[:, : x.shape[1]]


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal of rows."""
    n = x.shape[1]
    w = np.zeros(n)
    w[0] = 1
    w[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        w[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * w)


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def filtered(trials: DataFrame, srate: float, low: float = 0, high: float = 0, epoch: int = 0, order: int = 0, notch: bool = False, causal: bool = False) -> DataFrame:
    """``trials`` with ``x`` filtered, epoch by epoch."""
    n = order = filter_order(srate, low, high, order) if (low or high) else 0
    length = trials.select(F.size("x").alias("n")).first()["n"]
    epoch = epoch or length
    if length % epoch:
        raise ValueError("the length isn't a multiple of the epoch")
    check_filter(srate, low, high, epoch, n)
    h = fir(order, low, high, srate, notch)
    schema = T.StructType([f if f.name != "x" else T.StructField("x", T.ArrayType(T.DoubleType())) for f in trials.schema.fields])
    at = trials.columns.index("x")

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(at)).reshape(-1, epoch) if batch.num_rows else np.zeros((0, epoch))
            y = (forward if causal else forward_backward)(x, h).reshape(batch.num_rows, -1) if len(x) else x
            columns = list(batch.columns)
            columns[at] = pa.array(list(y), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return trials.mapInArrow(run, schema)


# -- time-frequency ----------------------------------------------------------


def frequency_bins(lo: float, hi: float, step: float) -> list[tuple[float, float]]:
    edges = np.arange(lo, hi + step / 2, step)
    return [(float(a), float(b)) for a, b in zip(edges[:-1], edges[1:])]


def analytic_signals(trials: DataFrame, srate: float, bins: list[tuple[float, float]], edge_frac: int = 8) -> DataFrame:
    """(channel, trial, freq_lo, freq_hi, frame, re, im): band-passed analytic
    signals, without the frames at both ends that filters distort."""
    frames = trials.select(F.size("x").alias("n")).first()["n"]
    schema = "channel int, trial long, freq_lo double, freq_hi double, frame int, re double, im double"
    edge = min(3 * int(srate / bins[0][0]), frames // edge_frac)

    def run(batches):
        for batch in batches:
            t = batch.to_pydict()
            x = np.array(t["x"], np.float64)
            if not len(x):
                continue
            kept = np.arange(edge, frames - edge, dtype=np.int32)
            for lo, hi in bins:
                order = min(max(16, filter_order(srate, lo, hi)), (frames // 3 - 2) // 2 * 2)
                z = analytic(forward_backward(x, fir(order, lo, hi, srate)))[:, kept]
                n = len(kept)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array(t["channel"], np.int32), n)),
                        pa.array(np.repeat(np.array(t["trial"], np.int64), n)),
                        pa.array(np.full(n * len(x), lo)),
                        pa.array(np.full(n * len(x), hi)),
                        pa.array(np.tile(kept, len(x))),
                        pa.array(z.real.ravel()),
                        pa.array(z.imag.ravel()),
                    ],
                    names=["channel", "trial", "freq_lo", "freq_hi", "frame", "re", "im"],
                )

    return trials.select("channel", "trial", "x").mapInArrow(run, schema)


def summarise_phase(z: DataFrame, *keys: str) -> DataFrame:
    """(keys, ersp, itc_re, itc_im, itc, ppc, n) of (re, im) rows."""
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    u = z.withColumn("_u", F.when(size > 0, F.col("re") / size).otherwise(0.0)).withColumn("_v", F.when(size > 0, F.col("im") / size).otherwise(0.0))
    s = u.groupBy(*keys).agg(
        F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("ersp"), F.avg("_u").alias("itc_re"), F.avg("_v").alias("itc_im"), F.count("*").alias("n")
    )
    itc2 = F.col("itc_re") * F.col("itc_re") + F.col("itc_im") * F.col("itc_im")
    ppc = (F.col("n") * itc2 - 1) / F.greatest(F.col("n") - 1, F.lit(1))
    return s.select(*keys, "ersp", "itc_re", "itc_im", F.sqrt(itc2).alias("itc"), ppc.alias("ppc"), "n")


def hilbert_tfa(trials: DataFrame, srate: float, lo: float, hi: float, step: float, edge_frac: int = 8) -> DataFrame:
    """(channel, freq_lo, freq_hi, frame, ersp, itc_re, itc_im, itc, ppc, n)."""
    return summarise_phase(analytic_signals(trials, srate, frequency_bins(lo, hi, step), edge_frac), "channel", "freq_lo", "freq_hi", "frame")


def bootstrap_thresholds(z: DataFrame, draws: int = 200, seed: int = 42) -> DataFrame:
    """(channel, freq_lo, frame, itc_thresh, ersp_thresh): 95th percentiles over
    resamplings of trials with replacement.

    Draw tables are joined by (channel, trial); percentiles are exact.
    """
    trials = z.select("channel", "trial").distinct()
    n = F.count("*").over(Window.partitionBy("channel"))
    ranked = trials.select("channel", "trial", n.alias("n"), (F.row_number().over(Window.partitionBy("channel").orderBy("trial")) - 1).alias("r"))
    slots = ranked.select("channel", "n", "r").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    pick = slots.select("channel", "draw", F.pmod(F.xxhash64(F.lit(seed), "draw", "channel", "r"), "n").alias("r"))
    times = pick.groupBy("channel", "draw", "r").agg(F.count("*").alias("w")).join(ranked.select("channel", "trial", "r"), ["channel", "r"]).select("channel", "draw", "trial", "w")
    s = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    u = z.select("channel", "freq_lo", "frame", "trial", (s * s).alias("p"), F.when(s > 0, F.col("re") / s).otherwise(0.0).alias("u"), F.when(s > 0, F.col("im") / s).otherwise(0.0).alias("v"))
    d = u.join(times, ["channel", "trial"]).groupBy("channel", "freq_lo", "frame", "draw").agg(
        (F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("p"), (F.sum(F.col("w") * F.col("u")) / F.sum("w")).alias("u"), (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v")
    )
    db = 10 * F.log10(F.col("p") + 1e-20)
    d = d.select("channel", "freq_lo", "frame", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")).alias("itc"), db.alias("db"))
    d = d.withColumn("dev", F.abs(F.col("db") - F.avg("db").over(Window.partitionBy("channel", "freq_lo", "frame"))))
    return d.groupBy("channel", "freq_lo", "frame").agg(F.percentile("itc", 0.95).alias("itc_thresh"), F.percentile("dev", 0.95).alias("ersp_thresh"))


def decibels(power: Column) -> Column:
    return 10 * F.log10(power + 1e-20)


def baseline(tfa: DataFrame, method: str = "zscore", start: float | None = None, end: float | None = None) -> DataFrame:
    """``tfa`` with ``value``: dB power as a global z-score, or less its mean over
    a window or over all frames of the frequency."""
    d = tfa.withColumn("_db", decibels(F.col("ersp")))
    every = Window.partitionBy("channel")
    per = Window.partitionBy("channel", "freq_lo")
    if method == "zscore":
        v = (F.col("_db") - F.avg("_db").over(every)) / F.stddev_pop("_db").over(every)
    elif method == "window":
        v = F.col("_db") - F.avg(F.when(F.col("frame").between(start, end), F.col("_db"))).over(per)
    elif method == "mean":
        v = F.col("_db") - F.avg("_db").over(per)
    else:
        raise ValueError("method is 'zscore', 'window' or 'mean'")
    return d.withColumn("value", v).drop("_db")


def panel(tfa: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """(…, itc, ppc) as shown: coherence under its threshold 0, ppc not negative."""
    if thresholds is None:
        return tfa.withColumn("ppc", F.greatest("ppc", F.lit(0.0)))
    j = tfa.join(thresholds, ["channel", "freq_lo", "frame"], "left")
    t2 = F.col("itc_thresh") * F.col("itc_thresh")
    limit = F.greatest(F.lit(0.0), (F.col("n") * t2 - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    return j.withColumn("itc", F.when(F.col("itc") < F.col("itc_thresh"), 0.0).otherwise(F.col("itc"))).withColumn(
        "ppc", F.when(F.col("ppc") < limit, 0.0).otherwise(F.greatest("ppc", F.lit(0.0)))
    )


def compare_panels(tfas: dict[str, DataFrame], value: str = "ersp") -> DataFrame:
    """(condition, …, limit): panels of two to four conditions with shared limits."""
    if not 2 <= len(tfas) <= 4:
        raise ValueError("two to four conditions")
    out = None
    for name, t in tfas.items():
        t = t.withColumn("condition", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out.withColumn("limit", F.max(F.abs(F.col(value))).over(Window.partitionBy("channel")))


# -- spectra -----------------------------------------------------------------


def power_spectrum(trials: DataFrame, srate: float, *keys: str) -> DataFrame:
    """(keys, freq, power): mean periodogram (Hann window) of trials."""
    kinds = ", ".join(f"`{k}` {trials.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index("x")))
            if not len(x):
                continue
            n = x.shape[1]
            w = np.hanning(n)
            p = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * w)) ** 2 / (srate * (w**2).sum())
            p[:, 1 : (n + 1) // 2] *= 2
            f = np.fft.rfftfreq(n, 1 / srate)
            columns = [batch.column(batch.schema.get_field_index(k)).take(pa.array(np.repeat(np.arange(len(x)), len(f)))) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(f, len(x))), pa.array(p.ravel())], names=[*keys, "freq", "p"])

    rows = trials.select(*keys, "x").mapInArrow(run, f"{kinds}, freq double, p double")
    return rows.groupBy(*keys, "freq").agg(F.avg("p").alias("power"))


def phase_amplitude(trials: DataFrame, srate: float, phases: list[tuple[float, float]], amplitudes: list[tuple[float, float]], bins: int = 18, *keys: str) -> DataFrame:
    """(keys, pha_lo, amp_lo, mi): Tort's modulation index, mean over trials."""
    kinds = "".join(f"`{k}` {trials.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index("x")))
            if not len(x):
                continue
            frames = x.shape[1]

            def band(lo, hi):
                order = min(max(16, filter_order(srate, lo, hi)), (frames // 3 - 2) // 2 * 2)
                return analytic(forward_backward(x, fir(order, lo, hi, srate)))

            amps = {b: np.abs(band(*b)) for b in amplitudes}
            for ph in phases:
                at = np.minimum(bins - 1, ((np.angle(band(*ph)) + np.pi) / (2 * np.pi) * bins).astype(int))
                for am, a in amps.items():
                    mi = np.empty(len(x))
                    for i in range(len(x)):
                        n = np.maximum(1, np.bincount(at[i], minlength=bins))
                        m = np.bincount(at[i], a[i], bins) / n
                        p = m / max(m.sum(), 1e-300)
                        mi[i] = 1 + (p[p > 0] * np.log(p[p > 0])).sum() / np.log(bins)
                    columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(x), ph[0])), pa.array(np.full(len(x), am[0])), pa.array(mi)], names=[*keys, "pha_lo", "amp_lo", "m"])

    rows = trials.select(*keys, "x").mapInArrow(run, f"{kinds}pha_lo double, amp_lo double, m double")
    return rows.groupBy(*keys, "pha_lo", "amp_lo").agg(F.avg("m").alias("mi"))


def matched(trials: DataFrame, matches: DataFrame, condition: str) -> DataFrame:
    """Trials of each (rep, condition) draw: a join by id, then any summary with
    ``rep`` and the condition among its keys.

    A merge join whatever the estimates say: Spark can't know how many rows an
    Arrow stage makes of a trial, and would send them all through the driver.
    """
    return matches.join(trials.withColumnRenamed("trial", "id").hint("merge"), ["id", condition]).withColumnRenamed("id", "trial")


def sift(x: np.ndarray, max_imfs: int = 8, rounds: int = 10) -> list[np.ndarray]:
    """Empirical mode decomposition: envelopes by linear interpolation through
    extremes, a fixed number of siftings for each mode."""
    t = np.arange(len(x))
    out, rest = [], x.astype(float)
    for _ in range(max_imfs):
        h = rest.copy()
        for _ in range(rounds):
            d = np.diff(h)
            up = np.flatnonzero((d[:-1] > 0) & (d[1:] <= 0)) + 1
            down = np.flatnonzero((d[:-1] < 0) & (d[1:] >= 0)) + 1
            if len(up) < 2 or len(down) < 2:
                return [*out, rest] if not out or np.ptp(rest) else out
            ends = [0, len(h) - 1]
            top = np.interp(t, np.r_[ends[0], up, ends[1]], np.r_[h[up[0]], h[up], h[up[-1]]])
            low = np.interp(t, np.r_[ends[0], down, ends[1]], np.r_[h[down[0]], h[down], h[down[-1]]])
            h = h - (top + low) / 2
        out.append(h)
        rest = rest - h
    return out


def decompose(trials: DataFrame, srate: float, max_imfs: int = 8) -> DataFrame:
    """(trial, imf, frame, frequency, amplitude) of each trial's modes."""
    schema = "trial long, imf int, frame int, frequency double, amplitude double"

    def run(batches):
        for batch in batches:
            t = batch.to_pydict()
            for key, x in zip(t["trial"], t["x"]):
                for k, h in enumerate(sift(np.array(x, float), max_imfs)):
                    z = analytic(h[None, :])[0]
                    f = np.gradient(np.unwrap(np.angle(z))) * srate / (2 * np.pi)
                    f = np.nanmedian(np.lib.stride_tricks.sliding_window_view(np.pad(f, 2, mode="edge"), 5), axis=1)
                    n = len(h)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * n, pa.int64()), pa.array(np.full(n, k, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(f), pa.array(np.abs(z))],
                        names=["trial", "imf", "frame", "frequency", "amplitude"],
                    )

    return trials.select("trial", "x").mapInArrow(run, schema)


def frequency_bin(f: Column, lo: float, hi: float, bins: int) -> Column:
    """Bin of f on equal edges, open below and closed above; null outside."""
    width = (hi - lo) / bins
    b = F.ceil((f - lo) / width) - 1
    return F.when((f > lo) & (f <= hi), F.least(F.lit(bins - 1), F.greatest(F.lit(0), b))).cast("int")


def marginal_spectrum(modes: DataFrame, lo: float = 0, hi: float = 100, bins: int = 100, *keys: str) -> DataFrame:
    """(keys, bin, amplitude): summed amplitude a trial in each frequency bin."""
    n = modes.groupBy(*keys).agg(F.count_distinct("trial").alias("n")) if keys else modes.agg(F.count_distinct("trial").alias("n"))
    s = modes.withColumn("bin", frequency_bin(F.col("frequency"), lo, hi, bins)).where("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.sum("amplitude").alias("a"))
    j = s.join(F.broadcast(n), list(keys)) if keys else s.crossJoin(F.broadcast(n))  # a row for each condition
    return j.select(*keys, "bin", (F.col("a") / F.col("n")).alias("amplitude"))


def matched_spectrum(modes: DataFrame, matches: DataFrame, condition: str, lo: float = 0, hi: float = 100, bins: int = 100) -> DataFrame:
    """(condition, rep, bin, amplitude): ``marginal_spectrum`` of each draw.

    Modes are computed once and become an array of ``bins`` sums a trial before
    they meet the draws; bins that no trial of a draw reaches are left out.
    """
    b = modes.withColumn("bin", frequency_bin(F.col("frequency"), lo, hi, bins))
    per = b.groupBy("trial", condition, "bin").agg(F.sum("amplitude").alias("a"))
    made = per.groupBy("trial", condition).agg(F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "a")))).alias("m"))
    spectra = made.select("trial", condition, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.element_at("m", k)).alias("x"))
    rows = matched(spectra, matches, condition).select(condition, "rep", F.posexplode("x").alias("bin", "a"))
    return rows.groupBy(condition, "rep", "bin").agg((F.sum("a") / F.count("*")).alias("amplitude")).where("amplitude IS NOT NULL")

"""The kernel bank's plan: kernels, dilations, quantiles and feature identities.

All of it is a function of the series length and two sizes, a few thousand rows
at most, so it is worked out on the driver and broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAPS = 9
POOLINGS = ("PPV", "MPV", "MIPV", "LSPV")
#: All kernels: 2 at three of nine taps, -1 elsewhere, in lexicographic order.
KERNELS = tuple(combinations(range(TAPS), 3))


def kernel_weights(index: int) -> list[float]:
    """The nine weights of a kernel; they sum to zero."""
    return [2.0 if k in KERNELS[index] else -1.0 for k in range(TAPS)]


def dilation_plan(length: int, num_features: int = 10000, max_dilations: int = 16) -> tuple[list[int], list[int]]:
    """Dilations and the biases of each for one representation of a series.

    A kernel gets ``num_features // 84`` biases spread over exponentially growing
    dilations, as many as ``max_dilations`` and the length allow.  Biases are
    counted against the dilations asked for, not those that exist, so shorter
    series get fewer.
    """
    per_kernel = num_features // len(KERNELS)
    asked = min(per_kernel, max_dilations)
    if asked < 1:
        raise ValueError(f"num_features must be at least {len(KERNELS)}")
    share = per_kernel / asked
    exponent = max(math.log2((length - 1) / (TAPS - 1)), 0.0) if length > 1 else 0.0
    n = min(asked, int(exponent) + 1)
    dilations = [int(2 ** (i * exponent / max(n - 1, 1))) for i in range(n)]
    biases: list[int] = []
    for i in range(n):
        biases.append(int((i + 1) * share - sum(biases)))
    return dilations, biases


def quantile(i: int) -> float:
    """i-th (from 0) point of the golden-ratio sequence."""
    return ((i + 1) * (1 + math.sqrt(5)) / 2) % 1.0


@dataclass(frozen=True)
class BankPlan:
    """Plan of both representations (raw series and first differences)."""

    length: int
    num_features: int = 10000
    max_dilations: int = 16

    def parts(self) -> list[tuple[str, int, list[int], list[int]]]:
        """(representation, length, dilations, biases per dilation)."""
        return [
            (rep, n, *dilation_plan(n, self.num_features, self.max_dilations))
            for rep, n in (("raw", self.length), ("diff", self.length - 1))
        ]

    @property
    def width(self) -> int:
        return sum(len(POOLINGS) * len(KERNELS) * sum(b) for _, _, _, b in self.parts())

    def columns(self) -> list[tuple[str, int, int, int]]:
        """(representation, dilation, kernel, bias slot) of each bias in order."""
        out = []
        for rep, _, dilations, biases in self.parts():
            slot = 0
            for d, n in zip(dilations, biases):
                for k in range(len(KERNELS)):
                    for _ in range(n):
                        out.append((rep, d, k, slot))
                        slot += 1
        return out


def kernels_df(spark: SparkSession) -> DataFrame:
    """(kernel_index, i0, i1, i2) as a self-join of the nine taps."""
    taps = spark.range(TAPS)
    i, j, k = (taps.select(F.col("id").cast("int").alias(n)) for n in ("i0", "i1", "i2"))
    joined = i.join(F.broadcast(j), F.col("i0") < F.col("i1")).join(F.broadcast(k), F.col("i1") < F.col("i2"))
    # rank of a combination among all: the combinations before it
    n0 = sum((F.when(F.col("i0") > a, F.lit(math.comb(TAPS - 1 - a, 2))).otherwise(0) for a in range(TAPS)), F.lit(0))
    n1 = sum((F.when((F.col("i1") > b) & (F.col("i0") < b), F.lit(TAPS - 1 - b)).otherwise(0) for b in range(TAPS)), F.lit(0))
    return joined.select((n0 + n1 + F.col("i2") - F.col("i1") - 1).cast("int").alias("kernel_index"), "i0", "i1", "i2")


def feature_dim(spark: SparkSession, plan: BankPlan, biases: list[float] | None = None) -> DataFrame:
    """One row for each feature: its place, kernel, dilation and pooling."""
    rows = []
    for b, (rep, d, k, _) in enumerate(plan.columns()):
        bias = float(biases[b]) if biases is not None else None
        for p, name in enumerate(POOLINGS):
            rows.append((4 * b + p, rep, d, 1 + (TAPS - 1) * d, k, *KERNELS[k], kernel_weights(k), bias, name, p))
    return spark.createDataFrame(
        rows,
        "feature_index int, representation string, dilation int, receptive_field int, kernel_index int,"
        " i0 int, i1 int, i2 int, weights array<float>, bias double, pooling_op string, pooling_index int",
    )


def decode(plan: BankPlan, index: int) -> dict:
    """Identity of one feature; an index outside of the bank is an error."""
    if not 0 <= index < plan.width:
        raise ValueError(f"feature {index} is outside of 0..{plan.width - 1}")
    rep, d, k, slot = plan.columns()[index // 4]
    return {
        "feature_index": index,
        "representation": rep,
        "dilation": d,
        "receptive_field": 1 + (TAPS - 1) * d,
        "kernel_index": k,
        "kernel_positive_indices": KERNELS[k],
        "kernel_weights": kernel_weights(k),
        "bias_slot": slot,
        "pooling_op": POOLINGS[index % 4],
        "pooling_index": index % 4,
    }

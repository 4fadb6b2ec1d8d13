"""The query that ``entry`` runs: series to pooled features to class averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens.operators import attribution as at
from chronolens.sources import series as src

from .catalog import ONE, _pool_sql


def pooled_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One narrow projection and one aggregation with partial sums."""
    p = at.pooled(src.embeddings(spark, sf_dir), [ONE])
    return p.groupBy("y").agg(
        F.count("*").alias("n"), *[(F.round(F.avg(F.round(c, 6)), 5) + 0.0).alias(c) for c in ("ppv", "mpv", "mipv", "lspv")]
    )


QUERIES = {"pooled_by_class": pooled_by_class}
ORACLES = {
    "pooled_by_class": f"SELECT y, CAST(count(*) AS BIGINT) AS n, round(avg(ppv), 5) AS ppv, round(avg(mpv), 5) + 0.0 AS mpv, round(avg(mipv), 5) + 0.0 AS mipv, round(avg(lspv), 5) AS lspv FROM ({_pool_sql([ONE])}) GROUP BY 1"
}

"""Loaders that turn tables into labelled fixed-length series.

Contract: ``id BIGINT, x ARRAY<DOUBLE>, y``; all rows of one length, no nulls and
no NaN (``checked`` rejects others).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checked(series: DataFrame, length: int | None = None) -> DataFrame:
    """``series`` as it is, failing at run time on ragged, null or NaN rows."""
    bad = F.col("x").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v.cast("double")))
    if length is not None:
        bad = bad | (F.size("x") != length)
    return series.withColumn("x", F.when(~bad, F.col("x")).otherwise(F.raise_error(F.lit("series row is null, ragged or holds NaN")).cast(series.schema["x"].dataType)))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y) of the embeddings table."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return t.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"))


def binned(rows: DataFrame, keys: Sequence[str], bin_: Column, value: Column, bins: int) -> DataFrame:
    """Sums of ``value`` per key and bin 0..bins-1 as an array; missing bins 0.

    One aggregation per (keys, bin), whose partial sums shrink the shuffle, then
    one per key over at most ``bins`` rows.
    """
    per = rows.groupBy(*keys, bin_.cast("int").alias("t")).agg(F.sum(value).alias("v")).where(F.col("t").between(0, bins - 1))
    made = per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("m"))
    x = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0)))
    return made.select(*keys, x.alias("x"))


#: The calendars' first days and lengths, if the caller names no others.
EVENT_START, EVENT_DAYS = "2024-01-01", 30
ORDER_START, ORDER_MONTHS = "1995-01-01", 80


def _day(start: str) -> Column:
    return F.datediff(F.to_date("ts"), F.lit(start).cast("date"))


def _month(start: str) -> Column:
    first = F.lit(start).cast("date")
    return (F.year("o_orderdate") - F.year(first)) * 12 + F.month("o_orderdate") - F.month(first)


def events_daily(spark: SparkSession, sf_dir: str, start: str = EVENT_START, days: int = EVENT_DAYS) -> DataFrame:
    """(id, x, y): each user's daily sums over ``days``; y = user modulo 3.

    Events outside of the calendar take no part; ``coverage`` counts them.
    """
    t = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id IS NOT NULL")
    s = binned(t, ["user_id"], _day(start), F.coalesce("value", F.lit(0.0)), days)
    return s.select(F.col("user_id").alias("id"), "x", (F.col("user_id") % 3).cast("int").alias("y"))


def events_channels(spark: SparkSession, sf_dir: str, start: str = EVENT_START, days: int = EVENT_DAYS) -> DataFrame:
    """(id, channel, x, y): the same by event type."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id IS NOT NULL AND event_type IS NOT NULL")
    s = binned(t, ["user_id", "event_type"], _day(start), F.coalesce("value", F.lit(0.0)), days)
    channel = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2)
    channel = channel.when(F.col("event_type") == "signup", 3).otherwise(4)
    return s.select(F.col("user_id").alias("id"), channel.alias("channel"), "x", (F.col("user_id") % 3).cast("int").alias("y"))


def orders_monthly(spark: SparkSession, sf_dir: str, start: str = ORDER_START, months: int = ORDER_MONTHS) -> DataFrame:
    """(id, x): each customer's monthly order totals from ``start`` on."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_custkey IS NOT NULL")
    return binned(t, ["o_custkey"], _month(start), F.col("o_totalprice"), months).select(F.col("o_custkey").alias("id"), "x")


def coverage(
    spark: SparkSession,
    sf_dir: str,
    event_start: str = EVENT_START,
    days: int = EVENT_DAYS,
    order_start: str = ORDER_START,
    months: int = ORDER_MONTHS,
) -> DataFrame:
    """(source, inside, outside, undated): rows that the calendars hold and leave out."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id IS NOT NULL")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_custkey IS NOT NULL")
    out = None
    for name, rows, at, bins in (("events", events, _day(event_start), days), ("orders", orders, _month(order_start), months)):
        inside = at.between(0, bins - 1)
        row = rows.agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"), F.count_if(at.isNull()).alias("undated"))
        row = row.select(F.lit(name).alias("source"), "inside", "outside", "undated")
        out = row if out is None else out.union(row)
    return out


def points(series: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row for each id (and key) and timepoint."""
    return series.select("id", *keys, F.posexplode("x").alias("t", "x"))


def from_wide(rows: DataFrame, columns: Sequence[str], label: str, id_column: str | None = None) -> DataFrame:
    """Series from a table with one column for each timepoint (CSV or Parquet)."""
    ident = F.col(id_column) if id_column else F.xxhash64(*columns, label)
    return rows.select(ident.alias("id"), F.array(*[F.col(c).cast("float") for c in columns]).alias("x"), F.col(label).alias("y"))


def map_labels(series: DataFrame, one: str = "1") -> DataFrame:
    """String labels as 0/1: ``one`` becomes 0, anything else 1."""
    return series.withColumn("y", F.when(F.col("y") == one, 0).otherwise(1))

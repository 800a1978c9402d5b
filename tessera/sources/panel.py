"""The analysis panel over the driver tables, and the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Added before rounding: quotients by powers of two would lie on ties, which engines round differently.
OFF_TIES = 3e-8


def numbered(days: DataFrame) -> DataFrame:
    """Adds day_idx, the place (from 0) of each datetime; one row a day, so one task is enough."""
    return days.withColumn("day_idx", (F.row_number().over(W.orderBy("datetime")) - 1).cast("int"))


def with_calendar(panel: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Adds day_idx by ``days`` (datetime, day_idx), or by the panel's own dates."""
    days = numbered(panel.select("datetime").distinct()) if days is None else days.select("datetime", "day_idx")
    return panel.join(F.broadcast(days), "datetime")  # one row a day


def week(column: str):
    return F.date_trunc("week", column).cast("date")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(datetime, day_idx, traded) of the weeks, from two columns of the lines alone."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(week("l_shipdate").alias("datetime"), (F.col("l_returnflag") != "R").alias("traded"))
    return numbered(lines.groupBy("datetime").agg(F.max("traded").alias("traded")))


def weekly_prices(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """Weekly price and volume of each supplier, of the weeks that begin by ``until``: the panel without returns."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        week("l_shipdate").alias("datetime"),
        F.col("l_suppkey").alias("instrument"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        "l_quantity",
        "l_extendedprice",
        "l_returnflag",
    )
    lines = lines if until is None else lines.where(F.col("datetime") <= F.lit(until).cast("date"))
    return lines.groupBy("datetime", "instrument").agg(
        F.round(F.avg("px") + OFF_TIES, 6).alias("close"),
        F.round(F.median("px") + OFF_TIES, 6).alias("open"),
        F.round(F.max("px") + OFF_TIES, 6).alias("high"),
        F.round(F.min("px") + OFF_TIES, 6).alias("low"),
        F.sum("l_quantity").alias("volume"),
        F.round(F.sum("l_extendedprice"), 2).alias("amount"),
        F.max(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).alias("tradestatus"),
    )


def panel(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """datetime, instrument, day_idx, prices, volume, amount, return, industry, tradestatus, of all days or those to ``until``: none depends on a later one."""
    own = W.partitionBy("instrument").orderBy("datetime")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("instrument"), F.col("s_nationkey").cast("double").alias("industry")
    )
    rows = weekly_prices(spark, sf_dir, until).join(suppliers, "instrument")
    change = F.col("close") / F.lag("close").over(own) - 1
    return with_calendar(rows.withColumn("return", F.round(change * F.lit(0.005), 9)), calendar(spark, sf_dir))

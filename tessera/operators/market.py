"""Market-data preparation: as-of joins, validity ranges, calendars, codes, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, default=None) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before its time, by key.

    Of repeated right keys the greatest value counts; null keys and values count
    for nothing.  Both sides are merged by key and month, so a key with a long
    history is many tasks' work.  What holds when a month begins is the last
    value of the months before: one row for each key and month that either side
    has, put in order once and brought back to the month's rows.
    """
    month, side = F.date_trunc("month", F.col(time)), F.lit(1)
    kept = [c for c in left.columns if c != value]
    given = right.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast(left.schema[key].dataType), F.col(time).cast(left.schema[time].dataType), F.col(value).alias("_v"))
    rows = left.select(*kept, F.lit(None).cast(given.schema["_v"].dataType).alias("_v"), side.alias("_side")).unionByName(given.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    rows = rows.withColumn("_m", month)
    marks = left.select(key, time, F.lit(None).cast(given.schema["_v"].dataType).alias("_v")).unionByName(given).withColumn("_m", month)
    marks = marks.groupBy(key, "_m").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(time, "_v"))).alias("_v"))
    before = W.partitionBy(key).orderBy("_m").rowsBetween(W.unboundedPreceding, -1)
    marks = marks.select(F.col(key).alias("_k"), F.col("_m").alias("_n"), F.last("_v", ignorenulls=True).over(before).alias("_carried")).where("_carried is not null")
    run = W.partitionBy(key, "_m").orderBy(time, "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("_own", F.last("_v", ignorenulls=True).over(run)).where("_side = 1")
    found = found.join(marks, (F.col(key) == F.col("_k")) & (F.col("_m") == F.col("_n")), "left")
    held = F.when(F.col(key).isNotNull(), F.coalesce("_own", "_carried"))
    found = found.withColumn(value, held if default is None else F.coalesce(held, F.lit(default)))
    return found.select(*left.columns, *([value] if value not in left.columns else []))


def membership_ranges(snapshots: DataFrame, calendar: DataFrame, group: str = "universe") -> DataFrame:
    """(group, instrument, from, to) of snapshots (group, date, instrument).

    A snapshot holds until the last calendar day before the group's next one,
    and from the calendar's first day at the earliest; empty ranges go.  The
    calendar, one entry a day, is looked up as one sorted array.
    """
    dates = snapshots.select(group, "date").distinct()
    dates = dates.withColumn("_next", F.lead("date").over(W.partitionBy(group).orderBy("date")))
    days = calendar.agg(F.sort_array(F.collect_set("datetime")).alias("_days"))
    dates = dates.crossJoin(F.broadcast(days))  # one row
    held = F.filter("_days", lambda d: (d >= F.col("date")) & (F.col("_next").isNull() | (d < F.col("_next"))))
    first = F.try_element_at("_days", F.lit(1))
    spans = dates.select(group, "date", F.greatest("date", first).alias("from"), F.try_element_at(held, F.lit(-1)).alias("to")).where("to is not null")
    return snapshots.distinct().join(spans, [group, "date"]).select(group, "instrument", "from", "to")


def within_membership(panel: DataFrame, ranges: DataFrame) -> DataFrame:
    """Panel rows inside a membership range of their instrument."""
    hit = (panel.instrument == ranges.instrument) & panel.datetime.between(ranges["from"], ranges["to"])
    return panel.join(ranges, hit, "left_semi")


def reindexed(panel: DataFrame, columns: list[str], days: DataFrame | None = None) -> DataFrame:
    """Each instrument on every calendar day between its first and last, NULL where it has no row.

    ``days`` (datetime, day_idx) is the calendar, if it is at hand; the grid is
    filled in from each row to the next, so nothing is joined to it.
    """
    days = panel.select("day_idx", "datetime").distinct() if days is None else days
    following = F.lead("day_idx").over(W.partitionBy("instrument").orderBy("day_idx"))
    rows = panel.select("instrument", "day_idx", *columns).withColumn("_next", F.coalesce(following, F.col("day_idx") + 1))
    rows = rows.withColumn("_at", F.explode(F.sequence("day_idx", F.col("_next") - 1)))
    own = {c: F.when(F.col("_at") == F.col("day_idx"), F.col(c)) for c in columns}
    rows = rows.withColumns(own).select("instrument", F.col("_at").alias("day_idx"), *columns)
    return rows.join(days.select("day_idx", "datetime"), "day_idx").select("instrument", "day_idx", "datetime", *columns)


def category_codes(rows: DataFrame, column: str) -> DataFrame:
    """(value, code): codes from 1 over the sorted distinct values, as doubles."""
    values = rows.select(F.col(column).alias("value")).where("value is not null").distinct()
    return values.withColumn("code", F.row_number().over(W.orderBy("value")).cast("double"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by ``order``."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")


def trading_calendar(panel: DataFrame) -> DataFrame:
    """Days with a row that traded, and their place from 0."""
    days = panel.where("tradestatus = 1").select("datetime").distinct()
    return days.withColumn("day_idx", (F.row_number().over(W.orderBy("datetime")) - 1).cast("int"))


def coverage(rows: DataFrame, time: str, instrument: str) -> DataFrame:
    """Counts of a manifest: rows, instruments, first and last day."""
    return rows.agg(
        F.count("*").alias("n_rows"), F.countDistinct(instrument).alias("n_instruments"), F.min(time).alias("first_day"), F.max(time).alias("last_day")
    )


def snapshot_counts(snapshots: DataFrame, group: str = "universe") -> DataFrame:
    return snapshots.groupBy(group).agg(F.countDistinct("date").alias("n_snapshots"))


def instrument_code(code):
    """``sh.600001`` as ``sh600001``, lower-cased."""
    return F.regexp_replace(F.lower(code), r"\.", "")


def vendor_code(code):
    """``sh600001`` as ``sh.600001``."""
    return F.concat_ws(".", F.substring(code, 1, 2), F.substring(code, 3, 32))


def month_ends_to(rows: DataFrame, start: str, end: str) -> DataFrame:
    """The last days of the months from start's to end's, the last of which may be past ``end``."""
    months = F.explode(F.sequence(F.trunc(start, "month"), F.col(end), F.expr("interval 1 month")))
    return rows.select(months.alias("_m"), end).select(F.last_day("_m").alias("month_end"), end)


def month_ends(rows: DataFrame, start: str, end: str) -> DataFrame:
    """The last days of the months from start's to end's, none past ``end``."""
    return month_ends_to(rows, start, end).where(F.col("month_end") <= F.col(end)).select("month_end")


def coerced(rows: DataFrame, numbers: list[str], flags: list[str]) -> DataFrame:
    """Texts as doubles, bad ones and NaN NULL; flags as ints, missing ones 0."""
    number = lambda c: F.expr(f"nullif(try_cast(`{c}` AS DOUBLE), double('NaN'))")
    flag = lambda c: F.expr(f"coalesce(cast(try_cast(`{c}` AS DOUBLE) AS INT), 0)")
    return rows.withColumns({c: number(c) for c in numbers} | {c: flag(c) for c in flags})

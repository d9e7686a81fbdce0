"""Order inside groups of any size, without sorting a whole group in one task.

Rows are put into days; a day of a group is sorted by itself, and what must
pass from day to day comes from one row per day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def _placed(df: DataFrame, group: str, at_us: str, ties: tuple[str, ...], value: Column, only: DataFrame | None) -> DataFrame:
    """Adds ``position`` (from 1) and ``_previous`` (a struct of the value before, null for the first)."""
    d = df.withColumn("_day", F.expr(f"{at_us} div {DAY_US}")).withColumn("_value", F.struct(value.alias("v")))
    days = d.groupBy(group, "_day").agg(F.count(F.lit(1)).alias("_n"), F.max_by("_value", F.struct(at_us, *ties)).alias("_last"))
    if only is not None:
        days = days.join(only, group, "left_semi")
    by_day = Window.partitionBy(group).orderBy("_day")
    before = F.coalesce(F.sum("_n").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select(group, "_day", before.alias("_before"), F.lag("_last").over(by_day).alias("_carried"))
    w = Window.partitionBy(group, "_day").orderBy(at_us, *ties)
    out = d.join(days, [group, "_day"]).withColumns({"position": F.col("_before") + F.row_number().over(w), "_previous": F.coalesce(F.lag("_value").over(w), F.col("_carried"))})
    return out.drop("_day", "_value", "_before", "_carried")


def in_order(df: DataFrame, group: str, at_us: str, *ties: str) -> DataFrame:
    """Adds ``position`` (from 1) of a row in its group, by time."""
    return _placed(df, group, at_us, ties, F.lit(0), None).drop("_previous")


def with_previous(df: DataFrame, group: str, at_us: str, value: Column, name: str, *ties: str) -> DataFrame:
    """Adds ``value`` of the row before in the group, by time; null for the first."""
    return _placed(df, group, at_us, ties, value, None).withColumn(name, F.col("_previous")["v"]).drop("_previous", "position")


def in_turn(df: DataFrame, group: str, at_us: str, value: Column, *ties: str, only: DataFrame | None = None) -> DataFrame:
    """Adds ``position`` and ``new_turn``, whether ``value`` isn't that of the row before; of the groups in ``only``, if given."""
    same = F.col("_previous")["v"].eqNullSafe(value)
    return _placed(df, group, at_us, ties, value, only).withColumn("new_turn", F.col("_previous").isNull() | ~same).drop("_previous")

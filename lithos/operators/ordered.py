"""Windows over groups of any size.

Rows are dealt in ranges of (group, order), each range is a window of its own,
and a row for each range and group carries what the others need. So a group that
holds a third of all rows is as many tasks' work as it has ranges. Groups and
orders are columns without nulls in the groups; an order tells the rows of a
group apart, or rows that it does not tell apart may change places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.plans.lineage import cut

_RANGE = "_range"


def ranged(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with the number of their range, written down, as ranges are drawn anew whenever they are computed."""
    return cut(rows.repartitionByRange(*group, *order).withColumn(_RANGE, F.spark_partition_id()))


def _carried(found: DataFrame, group: list[str], by_range: Column, over: Column, name: str) -> DataFrame:
    """``found`` with ``name``: ``over``, a window over the ranges of a group, of what ``by_range`` makes of each range (``_r``)."""
    ranges = found.groupBy(_RANGE, *group).agg(by_range.alias("_r"))
    return found.join(ranges.select(_RANGE, *group, over.alias(name)), [_RANGE, *group])


def running_sum(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` from the group's first row to this one."""
    found = ranged(rows, group, order)
    before = F.sum("_r").over(Window.partitionBy(*group).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1))
    own = F.sum(value).over(Window.partitionBy(_RANGE, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    met = _carried(found.withColumn("_own", own), group, F.sum(value), before, "_before")
    return met.withColumn(name, F.col("_own") + F.coalesce("_before", F.lit(0))).drop(_RANGE, "_own", "_before")


def latest(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the last ``value`` that is not null, from the group's first row to this one."""
    found = ranged(rows, group, order)
    before = F.last("_r", ignorenulls=True).over(Window.partitionBy(*group).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy(_RANGE, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    end = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    met = _carried(found.withColumn("_own", own), group, end, before, "_before")
    return met.withColumn(name, F.coalesce("_own", "_before")).drop(_RANGE, "_own", "_before")


def neighbours(rows: DataFrame, group: list[str], order: list[str], value: Column, previous: str | None = None, following: str | None = None) -> DataFrame:
    """``rows`` with ``value`` (a struct) of the rows before and after in their group; null where there is none."""
    found = ranged(rows.withColumn("_v", value), group, order)
    inside, across = Window.partitionBy(_RANGE, *group).orderBy(*order), Window.partitionBy(*group).orderBy(_RANGE)
    for name, step, pick in ((previous, F.lag, F.max_by), (following, F.lead, F.min_by)):
        if name:
            found = found.withColumn("_own", step("_v").over(inside))
            found = _carried(found, group, pick("_v", F.struct(*order)), step("_r").over(across), "_far")
            found = found.withColumn(name, F.coalesce("_own", "_far")).drop("_own", "_far")
    return found.drop(_RANGE, "_v")

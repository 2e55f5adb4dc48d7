"""Row numbers and running sums over a whole table without a one-task window.

The table is range-partitioned by the order and written; rows are numbered inside their range,
and each range starts where the ones before it end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash


def looked_up(values: dict[int, int], part: str) -> Column:
    """values of a column part, as one constant array with a place a partition."""
    dense = [values.get(k, 0) for k in range(max(values, default=-1) + 1)]
    return F.get(F.array(*map(F.lit, dense)).cast("array<bigint>"), F.col(part).cast("int"))


def _numbered(df: DataFrame, order: tuple) -> tuple[DataFrame, str, str]:
    """df, written in ranges of order, with two columns whose names it lacks: a row's number, and its range."""
    taken, names = {c.lower() for c in df.columns}, []
    for name in ("__at", "__part"):
        while name in taken:
            name += "_"
        names.append(name)
    at, part = names
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stash(ranged.withColumn(at, F.monotonically_increasing_id()), "ranges").withColumn(part, F.shiftright(at, 33)), at, part


def with_index(df: DataFrame, *order: Column | str, name: str = "index") -> DataFrame:
    """df and a gapless long from 0 by order; ties should be broken by order."""
    rows, at, in_part = _numbered(df, order)
    counts = sorted(map(tuple, rows.groupBy(in_part).count().collect()))  # a row a partition
    first, total = {}, 0
    for part, n in counts:
        first[part], total = total, total + n
    return rows.withColumn(name, looked_up(first, in_part) + F.col(at) - F.shiftleft(in_part, 33)).drop(at, in_part)


def with_running_sum(df: DataFrame, value: str, *order: Column | str, name: str = "running") -> DataFrame:
    """df and the sum of value over all rows before each one by order."""
    rows, at, in_part = _numbered(df, order)
    sums = sorted(map(tuple, rows.groupBy(in_part).agg(F.sum(value)).collect()))
    before, total = {}, 0
    for part, s in sums:
        before[part], total = total, total + (s or 0)
    within = Window.partitionBy(in_part).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, looked_up(before, in_part) + F.sum(value).over(within) - F.col(value)).drop(at, in_part)

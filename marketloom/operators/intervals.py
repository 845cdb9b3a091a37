"""Joins of dates with date intervals as exact equi-joins, and unions of intervals.

Days are the leaves of a binary tree: an interval of days is the disjoint union of at most two nodes a level, and a day lies
under one node of each level. A day and an interval that holds it share exactly one node, so joining on the node finds every
pair once and no other. Nodes are cut into cells of some CELL x CELL rows from counts of both sides, whatever one day, one
long interval or one node weighs; a row is copied once for CELL rows that it meets at a node, so copies stay far below the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of either side that meet in one cell, on average at most.
CELL = 512
#: Ends of intervals that are open.
FIRST_DAY, LAST_DAY = "0001-01-01", "9999-12-31"


def _shift(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x, k)


def _node(level: Column, at: Column) -> Column:
    return at * 64 + level


def _per_level(levels: int, nodes) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), nodes)


def nodes_over(day: Column, levels: int) -> Column:
    """The node of each level over a day, which is a long from 0."""
    return _per_level(levels, lambda k: _node(k, _shift(day, k)))


def nodes_covering(first: Column, last: Column, levels: int) -> Column:
    """The nodes of which the days first to last are the disjoint union."""

    def ends(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        a, b = _shift(first + size - 1, k), _shift(last + 1, k)
        left = F.when((a < b) & (a % 2 == 1), _node(k, a))
        return F.array(left, F.when((a + a % 2 < b) & (b % 2 == 1), _node(k, b - 1)))

    return F.array_compact(F.flatten(_per_level(levels, ends)))


def interval_join(points: DataFrame, on: str, intervals: DataFrame, first: str, last: str, cell: int = CELL) -> DataFrame:
    """Every row of points with every row of intervals that holds its day: all columns of both, which share no name.

    A null end is open, null days and intervals without any end meet nothing. Both inputs are read twice: pass written tables."""
    bounds = points.agg(F.min(on), F.max(on)).first()
    if bounds[0] is None:
        return points.join(intervals, F.lit(False))
    low = F.lit(bounds[0])
    span = (bounds[1] - bounds[0]).days
    levels = (span + 1).bit_length()
    day = lambda c: F.datediff(c, low).cast("long")
    held = intervals.where(F.col(first).isNotNull() | F.col(last).isNotNull()).withColumns({
        "_a": F.greatest(F.coalesce(day(F.col(first)), F.lit(0)), F.lit(0)),
        "_b": F.least(F.coalesce(day(F.col(last)), F.lit(span)), F.lit(span)),
    }).where("_a <= _b").withColumn("_node", F.explode(nodes_covering(F.col("_a"), F.col("_b"), levels))).drop("_a", "_b")
    dated = points.where(F.col(on).isNotNull())
    by_day = dated.groupBy(day(F.col(on)).alias("_day")).agg(F.count("*").alias("n"))
    n_points = by_day.select("n", F.explode(nodes_over(F.col("_day"), levels)).alias("_node")).groupBy("_node").agg(F.sum("n").alias("n"))
    n_held = held.groupBy("_node").agg(F.count("*").alias("m"))
    parts = lambda c: F.ceil(F.col(c) / cell).cast("int")
    grid = n_points.join(n_held, "_node").select("_node", parts("n").alias("_rows"), parts("m").alias("_cols"))
    own = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dated.withColumn("_node", F.explode(nodes_over(day(F.col(on)), levels))).join(grid, "_node")
    left = left.withColumns({"_row": own(points, "_rows"), "_col": every("_cols")}).drop("_rows", "_cols")
    right = held.join(grid, "_node").withColumns({"_col": own(intervals, "_cols"), "_row": every("_rows")}).drop("_rows", "_cols")
    return left.join(right, ["_node", "_row", "_col"]).drop("_node", "_row", "_col")


def merge_runs(intervals: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """The union of each key's intervals as disjoint runs that don't touch; open ends become FIRST_DAY and LAST_DAY.

    Intervals without any end are left out. A key has one row for each first day before the window, however many intervals it has."""
    open_to = lambda c, d: F.coalesce(F.col(c), F.lit(d).cast("date"))
    a = intervals.where(F.col(first).isNotNull() | F.col(last).isNotNull())
    a = a.select(*keys, open_to(first, FIRST_DAY).alias("_a"), open_to(last, LAST_DAY).alias("_b")).where("_a <= _b")
    a = a.groupBy(*keys, "_a").agg(F.max("_b").alias("_b"))
    before = W.partitionBy(*keys).orderBy("_a")
    reach = F.max("_b").over(before.rowsBetween(W.unboundedPreceding, -1))
    a = a.withColumn("_new", F.coalesce(F.datediff("_a", reach) > 1, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(before))
    return a.groupBy(*keys, "_run").agg(F.min("_a").alias(first), F.max("_b").alias(last)).drop("_run")

"""Memberships as intervals, a row for each stretch of steps in one group, and what changes alone tell of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import rand_of_cells


def to_intervals(memberships: DataFrame) -> DataFrame:
    """intervals(node, from, to, grp) of memberships(step, node, grp): the longest stretches of a node's rows without a change; to: the last step before the next one, or the node's last.

    As many rows as there are nodes and changes. A node's rows are as many as the record has steps."""
    order = Window.partitionBy("node").orderBy("step")
    rows = memberships.select("node", "step", "grp", F.lag("grp").over(order).alias("old"), F.max("step").over(Window.partitionBy("node")).alias("last"))
    starts = rows.where(F.col("old").isNull() | (F.col("old") != F.col("grp")))
    return starts.select("node", F.col("step").alias("from"), F.coalesce(F.lead("step").over(order) - 1, F.col("last")).alias("to"), "grp")


def to_memberships(intervals: DataFrame) -> DataFrame:
    """The dense table again: a row for every node and step."""
    return intervals.select(F.explode(F.sequence("from", "to")).alias("step"), "node", "grp")


def moves(intervals: DataFrame) -> DataFrame:
    """moves(step, node, old, grp): every start of an interval; old is null for a node's first."""
    return intervals.select(F.col("from").alias("step"), "node", F.lag("grp").over(Window.partitionBy("node").orderBy("from")).alias("old"), "grp")


def _grid(intervals: DataFrame, of: DataFrame) -> DataFrame:
    """of's rows (few) at every step from the first to the last."""
    ends = intervals.agg(F.min("from").alias("a"), F.max("to").alias("b")).where("a is not null")
    return of.crossJoin(F.broadcast(ends.select(F.explode(F.sequence("a", "b")).alias("step"))))


def interval_churn(intervals: DataFrame) -> DataFrame:
    """churn(step, changed): nodes whose label differs from the step before, from the intervals' starts."""
    changed = moves(intervals).where("old is not null").groupBy("step").agg(F.count("*").alias("changed"))
    one = intervals.sparkSession.range(1).drop("id")
    return _grid(intervals, one).join(changed, "step", "left").select("step", F.coalesce("changed", F.lit(0).cast("long")).alias("changed"))


def interval_sizes(intervals: DataFrame) -> DataFrame:
    """sizes(step, grp, n): nodes in each group that ever occurs, at every step: starts less ends, added up over the steps."""
    starts = intervals.select(F.col("from").alias("step"), "grp", F.lit(1).alias("d"))
    ends = intervals.select((F.col("to") + 1).alias("step"), "grp", F.lit(-1).alias("d"))
    deltas = starts.unionByName(ends).groupBy("step", "grp").agg(F.sum("d").alias("d"))
    grid = _grid(intervals, intervals.select("grp").distinct()).join(deltas, ["step", "grp"], "left")
    return grid.select("step", "grp", F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy("grp").orderBy("step")).alias("n"))


def rand_by_moves(intervals: DataFrame, truth: DataFrame) -> DataFrame:
    """ari(step, ari): the adjusted Rand index of truth(node, truth) and the labels at each step, for nodes that have both.

    The table of (truth, found) is counted once and then moved by the nodes that change; the index comes from the table of each step, as large as the groups squared."""
    known = intervals.join(truth.select("node", "truth"), "node")
    starts = known.select(F.col("from").alias("step"), "truth", F.col("grp").alias("found"), F.lit(1).alias("d"))
    ends = known.select((F.col("to") + 1).alias("step"), "truth", F.col("grp").alias("found"), F.lit(-1).alias("d"))
    deltas = starts.unionByName(ends).groupBy("step", "truth", "found").agg(F.sum("d").alias("d"))
    grid = _grid(known, deltas.select("truth", "found").distinct()).join(deltas, ["step", "truth", "found"], "left")
    upto = Window.partitionBy("truth", "found").orderBy("step")
    cells = grid.select("step", "truth", "found", F.sum(F.coalesce("d", F.lit(0))).over(upto).alias("n")).where("n > 0")
    return rand_of_cells(cells, ["step"])

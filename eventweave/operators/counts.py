"""Counting of events on edges over the update grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_counts(events: DataFrame, delta: float) -> DataFrame:
    """counts(step, src, dst, n): events in [step * delta, (step + 1) * delta). One aggregate for all intervals, and for all runs where events have a column run."""
    step = F.floor(F.col("t") / delta).cast("int")
    return events.groupBy(*(c for c in ("run",) if c in events.columns), step.alias("step"), "src", "dst").agg(F.count("*").alias("n"))


def cumulative_counts(counts: DataFrame) -> DataFrame:
    """Adds full: the edge's events up to and with the step."""
    order = Window.partitionBy("src", "dst").orderBy("step")
    return counts.withColumn("full", F.sum("n").over(order))


def first_seen(counts: DataFrame) -> DataFrame:
    """seen(src, dst, first_step): edges are there for sure from this step on."""
    return counts.groupBy("src", "dst").agg(F.min("step").alias("first_step"))


def arrival_lists(events: DataFrame, delta: float) -> DataFrame:
    """arrivals(step, src, dst, times): sorted times of an edge, an array for each interval, so arrays don't grow with the record's length."""
    step = F.floor(F.col("t") / delta).cast("int")
    return events.groupBy(step.alias("step"), "src", "dst").agg(F.sort_array(F.collect_list("t")).alias("times"))

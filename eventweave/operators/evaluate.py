"""Scores of estimates against the truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import gamma_quantile
from .scan import carry_last
from .storage import if_small


def adjusted_rand(labels: DataFrame, by: list[str], a: str = "truth", b: str = "found") -> DataFrame:
    """by columns and ari: the adjusted Rand index of two labellings, from their contingency table; 1 where both put all in one group or all apart."""
    return rand_of_cells(labels.groupBy(*by, a, b).agg(F.count("*").alias("n")), by, a, b)


def rand_of_cells(cells: DataFrame, by: list[str], a: str = "truth", b: str = "found") -> DataFrame:
    """The same from the contingency table (by, a, b, n)."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    inside = cells.groupBy(*by).agg(two("n").alias("both"), F.sum("n").alias("total"))
    for name in (a, b):
        side = cells.groupBy(*by, name).agg(F.sum("n").alias("n")).groupBy(*by).agg(two("n").alias(f"pairs_{name}"))
        inside = inside.join(side, by)
    expected = F.col(f"pairs_{a}") * F.col(f"pairs_{b}") / (F.col("total") * (F.col("total") - 1) / 2)
    most = (F.col(f"pairs_{a}") + F.col(f"pairs_{b}")) / 2
    ari = F.when(F.col("total") < 2, 1.0).when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected))
    return inside.select(*by, ari.alias("ari"))


def detection_scores(flags: DataFrame, runs: DataFrame, first: float, second: float, k: int, m: int, slack: float = 0.2) -> DataFrame:
    """scores(run, ccd, dnf) of flags(run, t, k, m): the share of the two true changes found, and of flags that are true.

    Flags count from the first change to the second plus slack, and after that; in each of the
    two windows one flag of the right pair of groups is true. Runs without flags score 0."""
    window = F.when(F.col("t") <= first, 0).when(F.col("t") <= second + slack, 1).otherwise(2)
    rows = flags.withColumn("window", window)
    per = rows.groupBy("run", "window").agg(F.count("*").alias("n"), F.max(((F.col("k") == k) & (F.col("m") == m) & (F.col("window") > 0)).cast("int")).alias("hit"))
    sums = per.groupBy("run").agg(F.sum("n").alias("n"), F.sum("hit").alias("hits"))
    return runs.join(sums, "run", "left").select("run", F.coalesce(F.col("hits") / 2, F.lit(0.0)).alias("ccd"), F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)).alias("dnf"))


def churn(memberships: DataFrame) -> DataFrame:
    """churn(step, changed): nodes whose label differs from the step before."""
    order = Window.partitionBy("node").orderBy("step")
    before = F.lag("grp").over(order)
    rows = memberships.select("step", (before.isNotNull() & (before != F.col("grp"))).cast("int").alias("changed"))
    return rows.groupBy("step").agg(F.sum("changed").alias("changed"))


def changed_nodes(memberships: DataFrame, steps: list[int]) -> DataFrame:
    """changes(step, node, old, grp) at the chosen steps."""
    order = Window.partitionBy("node").orderBy("step")
    rows = memberships.withColumn("old", F.lag("grp").over(order))
    return rows.where(F.col("step").isin(steps) & (F.col("old") != F.col("grp"))).select("step", "node", "old", "grp")


def group_share(memberships: DataFrame, grp: int, expected: float, other: float) -> DataFrame:
    """share(step, share) of a group, turned over if it begins nearer to the other share than to the expected."""
    shares = memberships.groupBy("step").agg(F.avg((F.col("grp") == grp).cast("double")).alias("share"))
    first = shares.agg(F.min_by("share", "step").alias("first"))
    turn = F.abs(F.col("first") - other) < F.abs(F.col("first") - expected)
    return shares.crossJoin(F.broadcast(first)).select("step", F.when(turn, 1 - F.col("share")).otherwise(F.col("share")).alias("share"))


def align_two(rates: DataFrame, at_step: int = 5) -> DataFrame:
    """Rates of two groups with the labels swapped, in runs where the highest mean rate at at_step lies on (1, 1)."""
    at = rates.where(F.col("step") == at_step).groupBy("run").agg(F.max_by(F.struct("k", "m"), F.struct(F.col("alpha") / F.col("beta"), -F.col("k"), -F.col("m"))).alias("top"))
    swap = (F.col("top.k") == 1) & (F.col("top.m") == 1)
    joined = rates.join(at, "run", "left")
    for c in ("k", "m"):
        joined = joined.withColumn(c, F.when(swap, 1 - F.col(c)).otherwise(F.col(c)))
    return joined.drop("top")


def _most_agreement(table: np.ndarray) -> int:
    """The greatest sum of one cell a row and column of a square table, by the Hungarian method."""
    size = len(table)
    cost, rows, columns = table.max(initial=0) - table, np.zeros(size + 1), np.zeros(size + 1)
    held = np.zeros(size + 1, int)  # the row (from 1) of each column (from 1); column 0 is where a row comes in
    for row in range(1, size + 1):
        held[0], at, slack, seen, way = row, 0, np.full(size + 1, np.inf), np.zeros(size + 1, bool), np.zeros(size + 1, int)
        while held[at]:
            seen[at] = True
            open_ = ~seen
            open_[0] = False
            now = np.append(np.inf, cost[held[at] - 1]) - rows[held[at]] - columns
            better = open_ & (now < slack)
            slack[better], way[better] = now[better], at
            to = int(np.where(open_, slack, np.inf).argmin())
            least = slack[to]
            rows[held[seen]] += least
            columns[seen] -= least
            slack[open_] -= least
            at = to
        while at:
            held[at], at = held[way[at]], way[at]
    return int(sum(table[held[c] - 1, c - 1] for c in range(1, size + 1)))


def _renaming(table: np.ndarray) -> list[tuple[int, int]]:
    """(found, truth) of the renaming that agrees most; of equals, the first in order.

    Groups are fixed one after another, each to the least label with which the best agreement can still be had."""
    best, left, chosen = _most_agreement(table), list(range(len(table))), []
    for i in range(len(table)):
        for t in left:
            others = [u for u in left if u != t]
            if table[i, t] + _most_agreement(table[i + 1 :][:, others]) == best:
                break
        best -= int(table[i, t])
        left.remove(t)
        chosen.append((i, t))
    return chosen


def best_alignment(labels: DataFrame, k: int) -> DataFrame:
    """mapping(found, truth): the renaming of groups that agrees most, from the k x k contingency table; of equals, the first in order."""
    table = np.zeros((k, k), np.int64)
    for r in labels.where(F.col("found").between(0, k - 1) & F.col("truth").between(0, k - 1)).groupBy("found", "truth").count().collect():
        table[r["found"], r["truth"]] = r["count"]
    return labels.sparkSession.createDataFrame(_renaming(table), "found int, truth int")


def alignments(labels: DataFrame, k: int, by: str = "step") -> DataFrame:
    """mapping(by, found, truth): best_alignment() for each value of by, each from its k x k table in a task."""
    cells = labels.where(F.col("found").between(0, k - 1) & F.col("truth").between(0, k - 1)).groupBy(by, "found", "truth").count()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((k, k), np.int64)
        table[pdf["found"], pdf["truth"]] = pdf["count"]
        found, truth = zip(*_renaming(table), strict=True)
        return pd.DataFrame({by: pdf[by].iloc[0], "found": found, "truth": truth})

    return cells.groupBy(by).applyInPandas(run, f"{by} {labels.schema[by].dataType.simpleString()}, found int, truth int")


def rate_envelope(rates: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """envelope(step, k, m, mean, low, high): posterior mean and quantiles, averaged over runs."""

    @F.pandas_udf("low double, high double")
    def quantiles(alpha: pd.Series, beta: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"low": gamma_quantile(alpha, low) / beta, "high": gamma_quantile(alpha, high) / beta})

    rows = rates.withColumn("q", quantiles("alpha", "beta"))
    return rows.groupBy("step", "k", "m").agg(F.avg(F.col("alpha") / F.col("beta")).alias("mean"), F.avg("q.low").alias("low"), F.avg("q.high").alias("high"))


def truth_at(changes: DataFrame, steps: DataFrame) -> DataFrame:
    """truth(step, node, grp): the label of a node's last change at or before each step; changes(node, t, grp), steps(step, t).

    Changes and steps are merged into one order, sorted by range, so no range join is needed and a node of
    many changes is spread over tasks (see carry_last()). Of changes at one time the one with the largest label counts. steps is a short table: it is broadcast after a count."""
    a = changes.select("node", "t", F.lit(0).alias("late"), F.lit(None).cast("int").alias("step"), "grp")
    b = changes.select("node").distinct().crossJoin(if_small(steps, 100_000)).select("node", "t", F.lit(1).alias("late"), F.col("step").cast("int").alias("step"), F.lit(None).cast("int").alias("grp"))
    rows = carry_last(a.unionByName(b).where("node is not null").withColumn("same", F.col("grp")), ["node"], ["t", "late", "same"], "grp")
    return rows.where("step is not null").select("step", "node", "grp")


def station_groups(stations: DataFrame, memberships: DataFrame) -> DataFrame:
    """stations with grp and shown: groups that occur, numbered from 0 by the least node of each."""
    first = memberships.groupBy("grp").agg(F.min("node").alias("node"))
    shown = first.select("grp", (F.row_number().over(Window.orderBy("node")) - 1).alias("shown"))  # a row for a group
    return stations.join(memberships.select("node", "grp"), "node").join(F.broadcast(shown), "grp")

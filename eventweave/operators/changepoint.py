"""Changes in rates and memberships, as outliers of divergences between posteriors."""

from __future__ import annotations

from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import gamma_kl, gamma_kl_of, js_term
from .scan import large_groups, medians_of
from .storage import staged


def kl_lags(rates: DataFrame, most: int) -> DataFrame:
    """kl(step, lag, k, m, kl): divergence of each posterior from those 1 .. most steps before."""
    order = Window.partitionBy("k", "m").orderBy("step")
    lags = F.array(*(F.struct(F.lit(i).alias("lag"), F.lag("alpha", i).over(order).alias("a"), F.lag("beta", i).over(order).alias("b")) for i in range(1, most + 1)))
    rows = rates.withColumn("lags", lags).select("step", "k", "m", "alpha", "beta", F.explode("lags").alias("x")).where("x.a is not null")
    kl = gamma_kl(F.col("alpha"), F.col("beta"), F.col("x.a"), F.col("x.b"))
    return rows.select("step", "x.lag", "k", "m", kl.alias("kl"))


def mad_score(value: Column, median: Column, mad: Column) -> Column:
    """Distance from the median in median absolute deviations; where those are 0, infinite for any distance and null for none."""
    off = F.abs(value - median)
    return F.when(mad > 0, off / mad).when(off > 0, F.lit(float("inf")))


def mad_scores(rows: DataFrame, value: str, by: list[str], most_rows: int = 100_000) -> DataFrame:
    """Adds median, mad and score of value among the rows with the same by columns. Two exact medians (see exact_medians()), joined back on by.

    The rows are staged, as every pass reads them; groups are counted once for both medians."""
    rows = staged(rows)
    hot = large_groups(rows, value, by, most_rows)
    joined = rows.join(medians_of(rows, value, by, hot), by)
    mads = medians_of(joined.withColumn("__off", F.abs(F.col(value) - F.col("median"))), "__off", by, hot, "mad")
    return joined.join(mads, by).withColumn("score", mad_score(F.col(value), F.col("median"), F.col("mad")))


def js_lags(history: DataFrame, k: int, most: int) -> DataFrame:
    """js(step, lag, node, js, moved) of tau histories (step, node, p0 ..): divergence of each step's
    shares from those of 1 .. most steps before, and whether the best group differs."""
    from .posterior import best_group

    history = history.select("step", "node", *(f"p{i}" for i in range(k)), best_group(k).alias("best"))
    order = Window.partitionBy("node").orderBy("step")
    columns = [*(f"p{i}" for i in range(k)), "best"]
    lags = F.array(*(F.struct(F.lit(lag).alias("lag"), *(F.lag(c, lag).over(order).alias(f"o{c}") for c in columns)) for lag in range(1, most + 1)))
    rows = history.withColumn("lags", lags).select("step", "node", *columns, F.explode("lags").alias("x")).where("x.op0 is not null")
    js = sum((js_term(F.col(f"p{i}"), F.col(f"x.op{i}")) for i in range(1, k)), js_term(F.col("p0"), F.col("x.op0"))) / 2
    return rows.select("step", "x.lag", "node", js.alias("js"), (F.col("best") != F.col("x.obest")).alias("moved"))


def js_flags(js: DataFrame, most: int, window: int, limit: float, most_rows: int = 100_000) -> DataFrame:
    """flags(step, node, low, moved, flagged), for all steps that have others before them in the window.

    A node is flagged when log |js| lies over limit median absolute deviations from the median at
    every lag, and its best group differs from all `most` before. Median and MAD are those of the
    window's steps before, over nodes and lags: each divergence goes to the few steps whose window
    holds it, so all steps are done at once; a step of more than most_rows is counted out (see exact_medians())."""
    js = staged(js.withColumn("log_js", F.log(F.abs("js"))))
    reach = F.sequence(F.col("step") + 1, F.col("step") + (window - most - 1))
    pool = js.select(F.explode(reach).alias("step"), "log_js")
    hot = large_groups(pool, "log_js", ["step"], most_rows)
    medians = staged(medians_of(pool, "log_js", ["step"], hot))  # as many rows as steps
    mads = medians_of(pool.join(medians, "step").withColumn("off", F.abs(F.col("log_js") - F.col("median"))), "off", ["step"], hot, "mad")
    now = js.join(medians, "step").join(mads, "step")
    score = F.coalesce(mad_score(F.col("log_js"), F.col("median"), F.col("mad")), F.lit(0.0))
    out = now.groupBy("step", "node").agg(F.min(score).alias("low"), F.bool_and("moved").alias("moved"))
    return out.withColumn("flagged", (F.col("low") > limit) & F.col("moved"))


def monitor(history: DataFrame, k: int, burn_in: int, buffer: int, lags: int, limit: float) -> DataFrame:
    """memberships_online(step, node, grp, flagged) of a tau history (step, node, p0 ..), from step burn_in on.

    Labels are those of step burn_in until a flag; flags begin after burn_in + buffer + 1 steps. A
    flag looks at the shares up to the step before, and gives the node its best group of the step."""
    from .posterior import best_group

    flags = js_flags(js_lags(history, k, lags), lags, buffer, limit)
    flags = flags.where(F.col("flagged") & (F.col("step") + 1 > burn_in + buffer + 1)).select((F.col("step") + 1).alias("step"), "node", "flagged")
    labels = history.select("step", "node", best_group(k).alias("grp"))
    later = labels.where(F.col("step") > burn_in).join(flags, ["step", "node"], "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    carried = carry_labels(labels.where(F.col("step") == burn_in), later)
    return carried.join(later.select("step", "node", "flagged"), ["step", "node"], "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))


def carry_labels(first: DataFrame, flags: DataFrame) -> DataFrame:
    """memberships(step, node, grp): the first labels, carried on until a flagged step gives a new one.

    first: (step, node, grp), flags: (step, node, grp of the step, flagged)."""
    order = Window.partitionBy("node").orderBy("step")
    rows = first.withColumn("flagged", F.lit(True)).unionByName(flags.select("step", "node", "grp", "flagged"))
    return rows.select("step", "node", F.last(F.when(F.col("flagged"), F.col("grp")), ignorenulls=True).over(order).alias("grp"))


def rate_changes(rates: DataFrame, burn_in: int, buffer: int, lags: int, limit: float) -> DataFrame:
    """changes(k, m, step): steps (1-based) at which a pair of groups begins to run off.

    A detector for each pair of groups walks its posteriors (step, k, m, alpha, beta; step 0 is the
    prior): after burn_in + buffer + 1 steps, the divergence from the buffer's last posterior is an
    outlier when it lies over limit MADs from the median of the divergences inside the buffer.
    `lags` outliers in a row are a change, stamped with the first; an inlier moves the buffer on;
    after a change the buffer is filled anew. The state isn't a window frame, so each pair's
    posteriors (as many as the record has steps) go through a small Python loop in a task of their own."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        detector = Detector(burn_in, buffer, lags, limit)
        found = [detector.push(float(a), float(b)) for a, b in zip(pdf["alpha"], pdf["beta"], strict=True)]
        return pd.DataFrame([(int(pdf["k"].iloc[0]), int(pdf["m"].iloc[0]), s) for s in found if s is not None], columns=["k", "m", "step"])

    return rates.groupBy("k", "m").applyInPandas(run, "k int, m int, step int")


class Detector:
    """Takes the posteriors of a pair of groups one by one, the prior first; push() gives the step at which a change began once it is told.

    Kept are the buffer, the last lags + 1 posteriors, the run of outliers and how far a buffer is filled anew: state() and restore() carry them over."""

    def __init__(self, burn_in: int, buffer: int, lags: int, limit: float) -> None:
        self.burn_in, self.buffer, self.lags, self.limit = burn_in, buffer, lags, limit
        self.seen, self.run, self.waiting = 0, 0, -1
        self.kept: list[tuple[float, float]] = []
        self.recent: list[tuple[float, float]] = []
        self._spread: tuple[float, float] | None = None

    def state(self) -> tuple:
        flat = lambda posts: [x for p in posts for x in p]
        return self.seen, self.run, self.waiting, flat(self.kept), flat(self.recent)

    def restore(self, seen: int, run: int, waiting: int, kept: list[float], recent: list[float]) -> None:
        pairs = lambda x: list(zip(x[::2], x[1::2], strict=True))
        self.seen, self.run, self.waiting, self.kept, self.recent, self._spread = seen, run, waiting, pairs(list(kept)), pairs(list(recent)), None

    def spread(self) -> tuple[float, float]:
        """Median and MAD of the divergences inside the buffer."""
        if self._spread is None:
            values = [gamma_kl_of(self.kept[i], self.kept[i - lag]) for lag in range(1, self.lags + 1) for i in range(lag, self.buffer)]
            middle = median(values)
            self._spread = middle, median(abs(v - middle) for v in values)
        return self._spread

    def push(self, alpha: float, beta: float) -> int | None:
        step, post, found = self.seen, (alpha, beta), None
        if self.burn_in <= step < self.burn_in + self.buffer:
            self.kept.append(post)
        elif step > self.burn_in + self.buffer + 1:
            if self.waiting >= 0:
                self.kept[self.waiting], self._spread = self.recent[0], None  # that of lags + 1 steps before
                self.waiting = self.waiting + 1 if self.waiting + 1 < self.buffer else -1
            else:
                middle, mad = self.spread()
                off = abs(gamma_kl_of(post, self.kept[-1]) - middle)
                if off / mad > self.limit if mad > 0 else off > 0:
                    self.run += 1
                    if self.run == self.lags:
                        found, self.run, self.waiting = step + 1 - self.lags, 0, 0
                else:
                    self.run, self.kept, self._spread = 0, [*self.kept[1:], post], None
        self.recent = [*self.recent, post][-(self.lags + 1) :]
        self.seen += 1
        return found

"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, small_batches, staged


def target_sizes(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares sum(sizes) by weight; none gets over most times its size, the excess goes round again."""
    targets, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s], float(sum(sizes))
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] >= most * sizes[i]]
        for i in full or open_:
            targets[i] = float(most * sizes[i]) if full else share * weights[i]
        if not full:
            break
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def pivot(p: np.ndarray, size: np.ndarray, coin: np.ndarray) -> int:
    """Rounds the probabilities p in place, but for one at most, whose index it returns (or -1).

    The open row meets the next: mass (p times size) moves from one to the other, up or down by
    a fair lot, until one is 0 or 1. So each p keeps its expectation and the sum of the masses
    stays as it is."""
    i = -1
    for j in range(len(p)):
        if not 0 < p[j] < 1:
            continue
        if i < 0:
            i = j
            continue
        up = min((1 - p[i]) * size[i], p[j] * size[j])
        down = min(p[i] * size[i], (1 - p[j]) * size[j])
        move = up if coin[j] * (up + down) < down else -down
        p[i], p[j] = p[i] + move / size[i], p[j] - move / size[j]
        for k in (i, j):
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = round(p[k])
        i = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return i


def _count_words(batches):
    for b in batches:
        texts = b.column("__text").cast(pa.binary()).to_pylist()
        sizes = pa.array([len(x.split()) if x else 0 for x in texts], pa.int64())
        yield b.drop_columns(["__text"]).append_column("size", sizes)


def _shares(rows: DataFrame, weights: tuple[float, ...], most: float, fan_in: int) -> DataFrame:
    """source, source_size, target and blocks of every source, as target_sizes() has them.

    A source is full when the share by weight is at least most times its size: when size / weight is at most
    some level. So sources are sums by weight and a search for that level, a few numbers on the driver, never the table."""
    table = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    table = staged(_numbered(table).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("no") % len(weights) + 1).cast("int"))))
    left, weight, level = 0.0, 0.0, 0.0
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    while True:  # each round fills at least one source, or ends
        full = F.col("source_size") <= level * F.col("weight")
        left, weight = table.where("source_size > 0").agg(F.sum(F.when(full, -float(most) * F.col("source_size")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not weight:
            break
        new = (total + left) / weight / most
        if new <= level * (1 + 1e-12):
            break
        level = new
    share = F.lit((total + (left or 0.0)) / weight if weight else 0.0) * F.col("weight")
    target = F.when(F.col("source_size") <= level * F.col("weight"), float(most) * F.col("source_size")).otherwise(share)
    return table.select("source", "source_size", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"), F.ceil(F.col("n") / fan_in).alias("blocks"))


def _numbered(table: DataFrame) -> DataFrame:
    """Adds no: the place of the source in code point order, null last, counted range by range without a single task for all."""
    ranged = staged(table.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a partition
    return ranged.join(F.broadcast(before), "__part").withColumn("no", F.col("__before") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__row", "__before")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most_copies: int = 3, seed: int = 7, fan_in: int = 8192, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: its id, source, size, source_size, target, copies, taken and the extra columns.

    size: runs of other than ASCII white space (null text: 0). Sources in code point order,
    null last, get the weights in turn, and targets as target_sizes() shares them. A row's
    expected copies are target / source_size; the fraction is rounded by pivot() in blocks of
    about fan_in rows of a source, largest first, and the open rows of the blocks meet in
    further levels of the same (a reduction tree) until one a source is left, which a lot
    decides. So a hot source is many tasks, and its taken words differ from its target by
    less than one document. Lots depend on seed, id and size only: reruns agree.

    Rows of size 0 take 0 words. Repeated rows count each; null ids are ids like others.
    Very long texts are counted whole. The table of sources stays in Spark, however long it is;
    an empty table gives an empty result. Other columns of docs don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("__text"), *(F.col(c).alias(f"__x{i}") for i, c in enumerate(extra)))
    schema = rows.drop("__text").schema.add("size", "long")
    rows = staged(rows.mapInArrow(_count_words, schema))

    shares = _shares(rows, weights, most_copies, fan_in)
    joined = rows.withColumnRenamed("source", "__s").join(if_small(shares, 10_000), F.col("__s").eqNullSafe(F.col("source")), "left").drop("__s")

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumns({"whole": F.floor(ratio), "p": ratio - F.floor(ratio)})
    joined = joined.withColumns({"p": F.when((F.col("size") == 0) | (F.col("p") < 1e-9), 0.0).otherwise(F.col("p")), "coin": F.pmod(F.xxhash64(F.lit(seed), "id", "size"), F.lit(1 << 40)) / float(1 << 40), "block": F.pmod(F.xxhash64(F.lit(seed + 1), "id", "size"), F.greatest("blocks", F.lit(1)))}).drop("blocks")
    schema = joined.schema

    def level(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "coin", "id"], ascending=[False, True, True])
            p, coin = pdf["p"].to_numpy(float, copy=True), pdf["coin"].to_numpy(float)
            i = pivot(p, pdf["size"].to_numpy(float), coin)
            if last and i >= 0:
                p[i] = float((coin[i] * 7919) % 1 < p[i])
            return pdf.assign(p=p)
        return run

    done, blocks = [], shares.agg(F.max("blocks")).first()[0] or 0
    while True:
        last = blocks <= 1
        joined = staged(joined.groupBy("source", "block").applyInPandas(level(last), schema))
        if last:
            break
        done.append(joined.where("p = 0 or p = 1"))
        joined = joined.where("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / fan_in))
        blocks = math.ceil(blocks / fan_in)
    for d in done:
        joined = joined.unionByName(d)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return joined.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(F.col(f"__x{i}").alias(c) for i, c in enumerate(extra)))

"""Helpers that the training-data operators share."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.storage import if_small, shared_root, staged, unstaged

__all__ = ["arrow_type", "ascii_lower", "connected_components", "if_small", "mark_perhaps", "one_of_repeats", "prefix_sums", "shared_root", "small_batches", "staged", "unstaged", "without_old_shuffles"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def small_batches(spark: SparkSession, most_mb: int = 8) -> None:
    """Bounds the Arrow batches of the session by bytes: long texts then don't add up in executors and Python workers.

    A setting of the session, as batches are cut when a plan runs; a lower one stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, "64m")).lower().rstrip("b")
    size = int(now[:-1]) << {"k": 10, "m": 20, "g": 30}[now[-1]] if now[-1] in "kmg" else int(now)
    if not 0 < size <= most_mb << 20:
        spark.conf.set(key, f"{most_mb}m")


def without_old_shuffles(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Has Spark remove the shuffle files of each table that the operator stages as soon as it is written, not when the driver's JVM happens to collect garbage.

    For operators that stage all they shuffle: nothing reads those files again. The session's setting comes back at the end."""

    @functools.wraps(operator)
    def run(rows: DataFrame, *args: object, **kwargs: object) -> DataFrame:
        key, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", rows.sparkSession.conf
        before = conf.get(key, "false")
        conf.set(key, "true")
        try:
            return operator(rows, *args, **kwargs)
        finally:
            conf.set(key, before)

    return run


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    """The Arrow type of a column, ids of any kind included."""
    return to_arrow_type(df.schema[name].dataType)


def one_of_repeats(df: DataFrame, *columns: str) -> DataFrame:
    """df with one of each set of rows that agree in the columns, nulls too.

    Only rows of such sets are shuffled; the table of them is small where tables are sound."""
    print_of = F.xxhash64(*columns)
    again = staged(df.groupBy(print_of.alias("__print")).count().where("count > 1").select("__print"))
    if again.isEmpty():
        return df
    same = print_of == F.col("__print")
    more = if_small(again, 200_000)
    return df.join(more, same, "left_anti").unionByName(df.join(more, same, "left_semi").dropDuplicates(list(columns)))


def prefix_sums(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with the sums of columns over the rows up to and with each, in order, inside each group of by (none: over all).

    Rows are sorted by range over partitions and staged; each partition adds up for itself, and only groups
    that go on from one partition into the next get what came before, a row for each such group and partition. So a
    group of any size is spread over tasks. order must tell the rows of a group apart, by must not be null."""
    rows = rows.withColumns({f"__{k}": c for k, c in sums.items()})
    rows = staged(rows.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    totals = rows.groupBy("__part", *by).agg(*(F.sum(f"__{k}").alias(f"__{k}") for k in sums))
    parts = Window.partitionBy(*by).orderBy("__part")  # a group's partitions
    before = totals.select("__part", *by, *((F.sum(f"__{k}").over(parts) - F.col(f"__{k}")).alias(f"__before_{k}") for k in sums), F.row_number().over(parts).alias("__no"))
    before = staged(before.where("__no > 1").drop("__no"))
    inside = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__{k}": F.sum(f"__{k}").over(inside) for k in sums}).join(if_small(before, 100_000), ["__part", *by], "left")
    out = rows.withColumns({k: F.col(f"__{k}") + F.coalesce(F.col(f"__before_{k}"), F.lit(0)) for k in sums})
    return out.drop("__part", *(f"__{k}" for k in sums), *(f"__before_{k}" for k in sums))


def mark_perhaps(rows: DataFrame, ids: DataFrame, name: str = "id", bits: int = 1 << 26) -> DataFrame:
    """rows with __perhaps: true where their id is in ids, and for a few others; no row is shuffled.

    A bit for each hash; the bitmaps that are broadcast have at most bits / 8 bytes (8 MB), however many ids there are.
    With far more ids than bits nearly all rows are marked."""
    at = F.pmod(F.xxhash64(name), F.lit(bits)) + 1
    maps = ids.select(at.alias("__at")).groupBy(F.bitmap_bucket_number("__at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__at")).alias("__map"))
    # As an array of ints, four bytes each, read out once for each map: a row then takes a bit of one number.
    number = lambda i: F.conv(F.hex(F.substring("__map", 4 * i + 1, F.lit(4))), 16, 10).cast("long")
    signed = lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("int")
    count = F.expr("octet_length(__map) div 4 - 1").cast("int")
    maps = maps.select("__bucket", F.transform(F.sequence(F.lit(0), count), lambda i: signed(number(i))).alias("__map"))
    place = F.bitmap_bit_position(at)
    bit = F.bit_get(F.get("__map", F.shiftright(place, 5).cast("int")), (24 - 8 * F.shiftright(place, 3).bitwiseAND(F.lit(3)) + place.bitwiseAND(F.lit(7))).cast("int"))
    found = rows.withColumn("__bucket", F.bitmap_bucket_number(at)).join(F.broadcast(maps), "__bucket", "left")
    return found.select(*rows.columns, F.coalesce(bit == 1, F.lit(False)).alias("__perhaps"))


def perhaps_in(rows: DataFrame, ids: DataFrame, name: str = "id", bits: int = 1 << 26) -> DataFrame:
    """Rows whose id is in ids, and a few more (see mark_perhaps()): a filter before a join, so that it shuffles less of what it drops."""
    return mark_perhaps(rows, ids, name, bits).where("__perhaps").select(rows.columns)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does the same on pure ASCII, several times faster."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component: the least node of it.

    Alternates large-star and small-star steps until the edges no longer change; each round
    is a few joins and map-side combined minima. Both sides of a join are staged tables, so that
    AQE can split a hub's rows. Edges with a null
    end and loops don't connect anything; without edges the result is empty."""
    order = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = staged(order(edges.select("a", "b")))
    while not now.isEmpty():
        both = now.union(now.select("b", "a"))
        least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = order(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))
        large = staged(large)
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")))
        last, now = now, staged(order(large.join(least, "a").select("b", "m").toDF("a", "b").union(least.toDF("a", "b"))))
        # Both are sets of pairs: as many, and none new, means that nothing changed.
        if last.count() == now.count() and now.join(last, ["a", "b"], "left_anti").isEmpty():
            break
    heads = now.select(F.col("b").alias("node")).distinct()
    return now.toDF("node", "component").union(heads.withColumn("component", F.col("node")))

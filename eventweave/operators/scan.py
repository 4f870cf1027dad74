"""Scans and selections that no single task does for a large group: recurrences, carried values, exact medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import if_small, staged


def carry_last(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """rows with value as the last one that isn't null, of its group's rows up to and with each in order.

    Rows are sorted by range over partitions, so a group of any size is spread; each partition carries on for itself,
    and a group that goes on from one partition into the next gets the last value of those before, from a table
    of a row for each such group and partition. by must not be null; rows that agree in by and order may come either way."""
    rows = staged(rows.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    parts = Window.partitionBy(*by).orderBy("__part")
    last = rows.groupBy("__part", *by).agg(F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("__value")))).alias("__last"))
    before = last.select("__part", *by, F.last("__last", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1))["__value"].alias("__before"))
    before = staged(before.where("__before is not null"))
    inside = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__here", F.last(value, ignorenulls=True).over(inside)).join(if_small(before, 100_000), ["__part", *by], "left")
    return rows.withColumn(value, F.coalesce("__here", "__before")).drop("__part", "__here", "__before")


def affine_scan(rows: DataFrame, by: list[str], index: str, mult: Column, adds: dict[str, Column], first: dict[str, float], chunk: int = 64, last: int | None = None) -> DataFrame:
    """rows' by and index with, for each name of adds, y = mult * y before + add, in order of index (whole numbers from 0) inside a group; first: y before all.

    Each row is an affine map. Maps of a chunk of indices are composed in a fold over an array of at most `chunk` rows; a chunk as a whole is a map
    again, and the maps of chunks go through the same scan, level by level, until a group is one chunk. What a chunk begins with is then
    put into its rows. So the work is linear in a group's rows and spread over tasks. An index occurs once in a group.
    last: the highest index there may be, if the caller knows it; a record of one chunk is then one lazy plan that nothing is written or counted for."""
    names = list(adds)
    rows = rows.select(*by, F.col(index).cast("long").alias("__i"), mult.cast("double").alias("__m"), *(adds[n].cast("double").alias(f"__{n}") for n in names))
    found = _scan(rows, by, names, first, chunk, last)
    return found.select(*by, F.col("__i").alias(index), *(F.col(f"__{n}").alias(n) for n in names))


def _scan(rows: DataFrame, by: list[str], names: list[str], first: dict[str, float], chunk: int, last: int | None) -> DataFrame:
    """(by, __i, __old_n, __n): each n before and after the row's map."""
    state = F.struct(F.lit(-1).cast("long").alias("i"), F.lit(1.0).alias("om"), F.lit(1.0).alias("m"), *(F.lit(0.0).alias(f"{x}{n}") for n in names for x in ("o", "y")))

    def compose(done: Column, x: Column) -> Column:
        end = F.element_at(done, -1)
        ys = [y for n in names for y in (end[f"y{n}"].alias(f"o{n}"), (x["__m"] * end[f"y{n}"] + x[f"__{n}"]).alias(f"y{n}"))]
        return F.concat(done, F.array(F.struct(x["__i"].alias("i"), end["m"].alias("om"), (x["__m"] * end["m"]).alias("m"), *ys)))

    steps = F.array_sort(F.collect_list(F.struct("__i", "__m", *(f"__{n}" for n in names))))
    folded = rows.groupBy(*by, F.floor(F.col("__i") / chunk).alias("__chunk")).agg(F.aggregate(steps, F.array(state), compose).alias("__maps"))
    whole = F.element_at("__maps", -1)
    if last is None or last >= chunk:
        folded = staged(folded)
        last = (folded.agg(F.max("__chunk")).first()[0] or 0) * chunk
    if last >= chunk:
        maps = folded.select(*by, F.col("__chunk").alias("__i"), whole["m"].alias("__m"), *(whole[f"y{n}"].alias(f"__{n}") for n in names))
        begins = _scan(maps, by, names, first, chunk, last // chunk).select(*by, F.col("__i").alias("__chunk"), *(F.col(f"__old_{n}").alias(f"__begin_{n}") for n in names))
        folded = folded.join(begins, [*by, "__chunk"])
    else:
        folded = folded.withColumns({f"__begin_{n}": F.lit(float(first[n])) for n in names})
    out = folded.select(*by, *(f"__begin_{n}" for n in names), F.explode(F.slice("__maps", 2, chunk)).alias("x"))
    ends = [v for n in names for v in ((F.col("x.om") * F.col(f"__begin_{n}") + F.col(f"x.o{n}")).alias(f"__old_{n}"), (F.col("x.m") * F.col(f"__begin_{n}") + F.col(f"x.y{n}")).alias(f"__{n}"))]
    return out.select(*by, F.col("x.i").alias("__i"), *ends)


def large_groups(rows: DataFrame, value: str, by: list[str], most_rows: int) -> DataFrame | None:
    """(by, __n): groups of more than most_rows values that aren't null, staged; none if there is no such group."""
    hot = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > most_rows)
    return None if hot.isEmpty() else staged(hot)


def exact_medians(rows: DataFrame, value: str, by: list[str], name: str = "median", most_rows: int = 100_000) -> DataFrame:
    """by columns and the exact median of value (double; nulls left out, NaN the largest) in each group.

    Groups of up to most_rows values take Spark's own median. Larger ones are counted out: values fall into buckets by sign and power
    of two, then into even parts of the bucket that holds the middle, until it holds one value. A round is one aggregate of all such groups at once that
    combines before the shuffle, so no task holds a group; with 4096 parts there are some six rounds at most. rows are read once more to count groups: best staged."""
    return medians_of(rows, value, by, large_groups(rows, value, by, most_rows), name)


def medians_of(rows: DataFrame, value: str, by: list[str], hot: DataFrame | None, name: str = "median") -> DataFrame:
    """exact_medians() with the large groups known: those of large_groups() for the same rows, or for another value that is null where this one is."""
    if hot is None:
        return rows.groupBy(*by).agg(F.median(value).alias(name))
    keys = if_small(hot, 100_000)
    few = rows.join(keys, by, "left_anti").groupBy(*by).agg(F.median(value).alias(name))
    return few.unionByName(_counted_out(rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v")), hot, by, name))


def _counted_out(rows: DataFrame, groups: DataFrame, by: list[str], name: str, parts: int = 4096) -> DataFrame:
    v, inf = F.col("__v"), F.lit(float("inf"))
    power = F.when(F.abs(v) == inf, F.lit(1024)).otherwise(F.floor(F.log2(F.abs(v)))) + 2000
    bucket = F.when(F.isnan(v), F.lit(9999)).when(v == 0, F.lit(0)).when(v > 0, power).otherwise(-power).cast("long")
    middle = F.array(F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2))
    open_ = groups.select(*by, F.explode(F.array_distinct(middle)).alias("__rank"), F.lit(None).cast("double").alias("__lo"), F.lit(None).cast("double").alias("__hi"), F.lit(0).cast("long").alias("__below"))
    open_, done, begun = staged(open_), None, False
    while not open_.isEmpty():
        near = rows.join(if_small(open_, 100_000), by)
        if begun:  # values of a bucket have one sign and lie within a factor of two
            near = near.where(v.between(F.col("__lo"), F.col("__hi")))
            bucket = F.floor((v - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * parts)
        counts = near.groupBy(*by, "__rank", "__below", bucket.alias("__bucket")).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        upto = F.sum("__n").over(Window.partitionBy(*by, "__rank").orderBy("__bucket"))  # as many rows as buckets
        counts = counts.withColumn("__upto", F.col("__below") + upto).where((F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__n")))
        found = staged(counts.select(*by, "__rank", "__lo", "__hi", (F.col("__upto") - F.col("__n")).alias("__below")))
        one = found.where("__lo = __hi").select(*by, "__rank", F.col("__lo").alias("__v"))
        done = one if done is None else done.unionByName(one)
        open_, begun = found.where("__lo <> __hi"), True
    ends = done.groupBy(*by).agg(F.min_by("__v", "__rank").alias("a"), F.max_by("__v", "__rank").alias("b"))
    return ends.select(*by, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * 0.5 + F.col("b") * 0.5).alias(name))

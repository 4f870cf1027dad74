"""Networks of timed events from raw tables, and tables of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_events(spark: SparkSession, sf_dir: str, runs: int = 0) -> DataFrame:
    """edge_events(src, dst, t): nation of the customer, nation of the supplier, days of the shipment since EPOCH; with runs, a column run from 0, by customer."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    run = [(F.col("o_custkey") % runs).cast("int").alias("run")] if runs else []
    return rows.select(*run, "src", "dst", F.datediff("l_shipdate", F.lit(EPOCH)).cast("double").alias("t"))


def transition_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_events(src, dst, t): event type, the same user's next, days since 2024."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst"), F.lead("ts").over(order).alias("at"))
    days = (F.unix_timestamp(F.col("at").cast("timestamp")) - F.unix_timestamp(F.to_timestamp(F.lit("2024-01-01")))) / 86400.0
    return rows.where("dst is not null").select("src", "dst", days.alias("t"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_events(src, dst, t): user, event type, days since 2024."""
    days = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.to_timestamp(F.lit("2024-01-01")))) / 86400.0
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"), days.alias("t"))


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    """Trips from CSV files (a folder or pattern): start, end, started, ended, as text. Other columns aren't read."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col("`StartStation Name`").alias("start"), F.col("`EndStation Name`").alias("end"), F.col("`Start Date`").alias("started"), F.col("`End Date`").alias("ended"))


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Stations from CSV: name, latitude, longitude."""
    rows = spark.read.schema("StationName string, latitude double, longitude double").option("header", True).option("quote", '"').csv(path)
    return rows.select(F.col("StationName").alias("name"), "latitude", "longitude")


def weekly_files(spark: SparkSession, first: str = "2019-01-02", last: str = "2022-01-04", number: int = 143, twice: int = 246) -> DataFrame:
    """file(no, name): a file a week; the number `twice` is used for two weeks."""
    weeks = spark.sql(f"SELECT posexplode(sequence(DATE '{first}', DATE '{last}', INTERVAL 7 DAYS)) AS (week, day)")
    no = number + F.col("week") - F.when(F.col("week") > twice - number, 1).otherwise(0)
    name = F.concat(no.cast("string"), F.lit("JourneyDataExtract"), F.date_format("day", "ddMMMyyyy"), F.lit("-"), F.date_format(F.date_add("day", 6), "ddMMMyyyy"), F.lit(".csv"))
    return weeks.select(no.cast("long").alias("no"), name.alias("name"))


def parameter_grid(spark: SparkSession, **values: list[float]) -> DataFrame:
    """Every combination of the values, numbered from 0 with the last name running fastest."""
    out = spark.range(1).select(F.lit(0).cast("long").alias("idx"))
    for name, options in values.items():
        own = spark.createDataFrame([(i, float(v)) for i, v in enumerate(options)], f"__i long, {name} double")
        out = out.crossJoin(F.broadcast(own)).withColumn("idx", F.col("idx") * len(options) + F.col("__i")).drop("__i")
    return out


def write_network(events: DataFrame, nodes: DataFrame, path: str) -> None:
    """A network as two tables in a folder, events and the map of its nodes; one that is there is replaced."""
    for name, table in (("events", events), ("nodes", nodes)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, nodes) of a folder that write_network() wrote."""
    return spark.read.parquet(f"{path}/events"), spark.read.parquet(f"{path}/nodes")


def write_grid(grid: DataFrame, path: str) -> None:
    """The grid as JSON lines."""
    grid.write.json(path)


def read_setting(spark: SparkSession, path: str, idx: int) -> dict:
    """The values of one row of a grid."""
    row = spark.read.json(path).where(F.col("idx") == idx).first()
    if row is None:
        raise ValueError(f"no setting {idx}")
    return {k: v for k, v in row.asDict().items() if k != "idx"}


def find_setting(spark: SparkSession, path: str, **values: float) -> int:
    """The number of the row of a grid that has these values."""
    rows = spark.read.json(path)
    for name, value in values.items():
        rows = rows.where(F.col(name) == value)
    found = [r["idx"] for r in rows.select("idx").orderBy("idx").take(2)]
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} setting with {values}")
    return found[0]


def write_run(df: DataFrame, path: str, study: str, idx: int, run: int) -> None:
    """Writes an artefact of a run to a table partitioned by study, idx and run; a run that is written again takes the place of its rows."""
    rows = df.withColumns({"study": F.lit(study), "idx": F.lit(idx), "run": F.lit(run)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("study", "idx", "run").parquet(path)


def read_runs(spark: SparkSession, path: str, study: str, idx: int | None = None) -> DataFrame:
    """The rows of a study's runs, or of those with one setting, with idx and run; other partitions aren't read."""
    rows = spark.read.parquet(path).where(F.col("study") == study).drop("study")
    return rows if idx is None else rows.where(F.col("idx") == idx)

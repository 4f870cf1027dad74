"""Live operation: interval counts of an event stream, and the model that they move on."""

from __future__ import annotations

import json

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.online import TABLES, Options, State, advance, release


def stream_counts(events: DataFrame, interval: str, late: str) -> DataFrame:
    """counts(at, src, dst, n) of a stream (ts, src, dst), by tumbling windows; events later than `late` are left out."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", interval).alias("w"), "src", "dst").agg(F.count("*").alias("n"))
    return windows.select(F.col("w.start").alias("at"), "src", "dst", "n")


SAVED = ("edges", *TABLES)
LOG = "batch_id long, step int, params string, kept array<string>"
RATES = "step int, k int, m int, alpha double, beta double"


def save_state(state: State, folder: str, batch_id: int) -> None:
    """Writes the tables of a state and the rates since the last save under its batch, and then a row of the log, which makes it count.

    The batch before stays, as its log row counts until the new one is written; tables of earlier batches are deleted, rates stay."""
    spark = state.tau.sparkSession
    kept = [name for name in SAVED if getattr(state, name) is not None]
    for name in kept:
        getattr(state, name).write.mode("overwrite").parquet(f"{folder}/tables/{batch_id}/{name}")
    spark.createDataFrame(state.rate_log, RATES).coalesce(1).write.mode("overwrite").parquet(f"{folder}/rates/batch={batch_id}")
    params = {k: np.asarray(v).tolist() for k, v in state.params.items()}
    before = _log(spark, folder)
    spark.createDataFrame([(batch_id, state.step, json.dumps(params), kept)], LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    done = [] if before is None else sorted(r["batch_id"] for r in before.select("batch_id").where(F.col("batch_id") < batch_id).orderBy(F.col("batch_id").desc()).limit(3).collect())
    for old in done[:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/tables/{old}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _log(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(LOG).parquet(f"{folder}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_state(spark: SparkSession, options: Options, folder: str) -> tuple[State, int] | None:
    """The last state in the folder and its batch; None where there is none. Its rates are in saved_rates()."""
    log = _log(spark, folder)
    r = None if log is None else log.orderBy(F.col("batch_id").desc()).first()
    if r is None:
        return None
    tables = {name: spark.read.parquet(f"{folder}/tables/{r['batch_id']}/{name}") for name in r["kept"]}
    params = {k: np.asarray(v) if isinstance(v, list) else v for k, v in json.loads(r["params"]).items()}
    return State(options=options, step=r["step"], params=params, **tables), r["batch_id"]


def saved_rates(spark: SparkSession, folder: str) -> DataFrame:
    """rate_post(step, k, m, alpha, beta) of all batches that the log holds."""
    rates = spark.read.schema(f"{RATES}, batch long").parquet(f"{folder}/rates")
    return rates.join(_log(spark, folder).select(F.col("batch_id").alias("batch")), "batch", "left_semi").drop("batch")


class OnlineModel:
    """Moves a state on, an interval at a time, as finished windows come in.

    With a folder (shared by driver and executors), the state is written there after each batch:
    a model started anew on the folder and the stream's checkpoint goes on from it, and passes over
    a batch that it has taken already. Tables of earlier intervals and batches are deleted, so what is kept doesn't grow but for the rates."""

    def __init__(self, state: State, first: str, seconds: int, folder: str | None = None) -> None:
        self.state, self.first, self.seconds, self.folder, self.taken = state, first, seconds, folder, -1
        kept = load_state(state.tau.sparkSession, state.options, folder) if folder else None
        if kept:
            self.state, self.taken = kept

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch function: a micro-batch holds whole windows (append mode), in order of time; one before the state's step is an error."""
        if batch_id <= self.taken:
            return
        no = F.floor((F.unix_timestamp("at") - F.unix_timestamp(F.to_timestamp(F.lit(self.first)))) / self.seconds).cast("int")
        rows = batch.select(no.alias("step"), "src", "dst", "n").persist()
        earliest, last = rows.agg(F.min("step"), F.max("step")).first()
        if earliest is not None and earliest < self.state.step:
            rows.unpersist()
            raise ValueError(f"a window of interval {earliest} comes in at interval {self.state.step}")
        while last is not None and self.state.step <= last:  # an interval without events moves the state on too
            before, self.state = self.state, advance(self.state, rows.where(F.col("step") == self.state.step))
            release(before, self.state)
        rows.unpersist()
        if self.folder and last is not None:
            save_state(self.state, self.folder, batch_id)
            self.state.rate_log = []  # they are saved
        self.taken = batch_id

    def start(self, counts: DataFrame, checkpoint: str) -> StreamingQuery:
        return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(self.take).start()

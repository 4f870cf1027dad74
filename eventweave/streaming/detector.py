"""The rate detector on a stream: its state is Spark's, a pair of groups at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.changepoint import Detector

STATE = "seen int, run int, waiting int, kept array<double>, recent array<double>"
CHANGES = "k int, m int, step int"


class RateWatch(StatefulProcessor):
    """Moves a pair's Detector on with each batch's posteriors; between batches it lies in the state store."""

    def __init__(self, burn_in: int, buffer: int, lags: int, limit: float) -> None:
        self.settings = (burn_in, buffer, lags, limit)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("detector", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        detector, found = Detector(*self.settings), []
        if self.held.exists():
            detector.restore(*self.held.get())
        posts = pd.concat(list(rows)).sort_values("step")
        for step, alpha, beta in zip(posts["step"].tolist(), posts["alpha"].tolist(), posts["beta"].tolist(), strict=True):
            if step < detector.seen:
                continue  # told before
            if step > detector.seen:
                raise ValueError(f"step {step} of groups {key} comes in where {detector.seen} is to")
            change = detector.push(alpha, beta)
            if change is not None:
                found.append((*map(int, key), change))
        self.held.update(detector.state())
        if found:
            yield pd.DataFrame(found, columns=["k", "m", "step"])

    def close(self) -> None:
        pass


def watch_rates(rates: DataFrame, burn_in: int, buffer: int, lags: int, limit: float) -> DataFrame:
    """changes(k, m, step) of a stream of posteriors (step, k, m, alpha, beta; step 0 is the prior), as rate_changes() gives them of a table.

    A pair's steps come in order from batch to batch, in any order inside one; repeated steps are passed over, a step left out is an error.
    The state (a buffer of posteriors a pair) is in Spark's state store, keyed by pair, so pairs are spread over executors and a restart from the checkpoint goes on."""
    spark, key = rates.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the one that takes such state
    return rates.groupBy("k", "m").transformWithStateInPandas(RateWatch(burn_in, buffer, lags, limit), CHANGES, "append", "none")

"""Quality classifier: logistic regression on hashed word n-grams, learned by follow-the-regularised-leader."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import small_batches
from .words import mix, scan

BITS = 18


def ngram_slots(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the slots (of 2**BITS) of its words, word pairs, shapes and shape pairs, one for each occurrence.

    Words are runs of other than ASCII white space, cases kept; a shape is the kinds of characters
    in a word and which signs. A word that repeats the one before it makes the pair "same" with
    it, whatever it is. Empty and null texts have none."""
    mul = np.uint64(0x9E3779B97F4A7C15)
    for words in scan([t or "" for t in texts]):
        word, shape = words.hashes(), mix(words.classes().astype(np.uint64) + np.uint64(1))
        same, one = word[1:] == word[:-1], np.uint64(1)
        slots = [word, np.where(same, one, mix(word[:-1] * mul ^ word[1:])), shape, mix(shape[:-1] * mul ^ shape[1:] ^ one)]
        slots = [(x >> np.uint64(64 - BITS)).astype(np.int64) for x in slots]
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            yield np.concatenate([slots[0][a:b], slots[1][a : b - 1], slots[2][a:b], slots[3][a : b - 1]]) if b > a else slots[0][:0]


def margin(weights: np.ndarray, slots: np.ndarray) -> float:
    """Sparse dot product of the weights with the n-grams' shares, times SCALE, plus the bias (the last weight)."""
    return float(weights[-1] + (SCALE * weights[slots].mean() if len(slots) else 0.0))


SCALE = 30.0


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """FTRL-proximal over the rows (slots, label) in their order; returns 2**BITS weights and the bias."""
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
    packed = []
    for slots, label in rows:
        at, count = np.unique(slots, return_counts=True)
        packed.append((np.append(at, 2**BITS), np.append(SCALE * count / max(1, len(slots)), 1.0), label))
    weight = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    for _ in range(epochs):
        for at, x, label in packed:
            w = weight(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    return weight(z, n)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 8000, shards: int = 4) -> np.ndarray:
    """Weights learned from at most most_rows labelled rows that aren't held out.

    The bound is the parameter: the rows with the least hash of their id are taken, so reruns
    agree. Each of the shards learns apart, in a task of its own, and the weights are averaged.
    Labels that are null or not 0 or 1 don't count; of several labels of an id, the largest does.
    Rows that repeat an id count each; texts of any length are read whole, null ones as empty. Other columns don't matter. Rows are learned from in the order
    of a hash of their id, then of the text. Without labelled rows, as in an empty table, all weights are 0, and all scores 0.5."""
    small_batches(docs.sparkSession)
    usable = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("__y"))
    sample = usable.orderBy(F.xxhash64(id_col), id_col).limit(most_rows).withColumnRenamed(id_col, "__label_id")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), F.col("__id") == F.col("__label_id"))
    rows = rows.select("__id", "__text", F.col("__y").cast("int").alias("__y"), F.pmod(F.xxhash64("__id"), F.lit(shards)).cast("int").alias("shard"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(h=[zlib.crc32(str(i).encode()) for i in pdf["__id"]]).sort_values(["h", "__id", "__text"])[:most_rows]
        w = ftrl(list(zip(ngram_slots(list(pdf["__text"])), map(int, pdf["__y"]), strict=True)))
        at = np.flatnonzero(w)
        return pd.DataFrame({"shard": int(pdf["shard"].iloc[0]), "n": len(pdf), "at": [at.astype("i4").tobytes()], "w": [w[at].astype("f8").tobytes()]})

    total, rows_seen = np.zeros(2**BITS + 1), 0
    for r in sorted(rows.groupBy("shard").applyInPandas(learn, "shard int, n long, at binary, w binary").collect(), key=lambda r: r["shard"]):
        total[np.frombuffer(r["at"], "i4")] += np.frombuffer(r["w"], "f8") * r["n"]
        rows_seen += r["n"]
    return total / max(1, rows_seen)


def score_quality(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds score_col (0 to 1; higher: label 1 is likelier) to every row, from its whole text alone.

    Null and empty texts get the score of the bias; very long ones are read whole. Each of repeated rows is scored, equal texts alike;
    an empty table gives an empty result. A column named score_col is replaced; others are kept. Where a threshold falls on a score, that row is the caller's to place."""
    docs = docs.drop(score_col)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS + 1 numbers
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            m = np.array([margin(w, x) for x in ngram_slots(b.column(text_col).to_pylist())], float)
            yield b.append_column(score_col, pa.array(1 / (1 + np.exp(-np.clip(m, -35, 35)))))

    return docs.mapInArrow(run, schema)

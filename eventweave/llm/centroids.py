"""Centroid clustering on integers: float32 products first, exact integers where they can't tell."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from .common import small_batches, staged

LONG, LIMB = (1 << 63) - 1, 32
#: Unit roundoffs of float32 and float64.
U32, U64 = 2.0**-24, 2.0**-53


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(1024 x) of doubles: int64 where all are below 2**52, else Python's integers."""
    if not x.size or float(np.abs(x).max()) < 2.0**42:
        return np.floor(x * 1024.0).astype(np.int64)
    exact = [int(v) * 1024 if abs(v) >= 2.0**52 else math.floor(v * 1024.0) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def bounds(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of |c|^2 - 2 x c for each row of x (whole numbers as doubles) and each centre, from float32 products.

    Rounding both vectors to float32, multiplying and adding up n terms in any order is off by at most
    g(n + 2) |x| |c|, where g(m) = m u / (1 - m u) for the unit roundoff u of float32. |c|^2, the sums of
    doubles and the bounds' own rounding have a term of float64's roundoff. Where float32 overflows, bounds are infinite."""
    n = x.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        product = (x.astype(np.float32) @ centres.astype(np.float32).T).astype(np.float64)
        length, square = np.sqrt((x * x).sum(axis=1))[:, None], (centres * centres).sum(axis=1)
        both = length * np.sqrt(square)
        g = (n + 2) * U32 / (1 - (n + 2) * U32)
        off = 2 * g * both * (1 + 1e-6) + 8 * (n + 4) * U64 * (square + 2 * both) + 1e-30
        middle = square - 2 * product
        low, high = middle - off, middle + off
    sound = np.isfinite(low) & np.isfinite(high)
    return np.where(sound, low, -np.inf), np.where(sound, high, np.inf)


def _doubles(x: np.ndarray) -> np.ndarray:
    """The nearest doubles; beyond their range infinite, so that bounds tell nothing."""
    try:
        return x.astype(np.float64)
    except OverflowError:
        return np.array([math.copysign(math.inf, v) if abs(v) >= 1 << 1023 else float(v) for v in x.ravel().tolist()]).reshape(x.shape)


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centre, or of rows to rows: int64 where it can hold them."""
    if x.dtype != object and centre.dtype != object:
        most = max(float(np.abs(x).max(initial=0)), float(np.abs(centre).max(initial=0)))
        if 4.0 * most * most * max(1, x.shape[-1]) < 2.0**62:
            d = x - centre
            return (d * d).sum(axis=-1)
    d = x.astype(object) - centre.astype(object)
    return (d * d).sum(axis=-1)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of whole numbers the nearest centre, ties to the smaller number, and how many rows were open after the float32 products.

    Only centres whose interval reaches below the least upper bound can be nearest; where that is more than one, they are compared as integers."""
    low, high = bounds(_doubles(x), _doubles(centres))
    likely = low <= high.min(axis=1, keepdims=True)
    best = likely.argmax(axis=1)
    unsure = np.flatnonzero(likely.sum(axis=1) > 1)
    if len(unsure):
        least = np.full(len(unsure), None, object)
        for c in range(len(centres)):  # smaller numbers first, so that only a nearer one replaces it
            at = np.flatnonzero(likely[unsure, c])
            d = squared(x[unsure[at]], centres[c])
            nearer = np.array([least[i] is None or v < least[i] for i, v in zip(at, d.tolist(), strict=True)], bool)
            least[at[nearer]] = np.array(d.tolist(), object)[nearer]
            best[unsure[at[nearer]]] = c
    return best, unsure


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return whole_numbers(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, salt: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): each kept vector with its cluster and squared distance, after `rounds` rounds from the k kept vectors of the least hashes.

    Kept are vectors of exactly `size` components, none null or not finite; a component x becomes floor(1024 x).
    A round is one pass over the table: a task assigns its rows (see nearest()) and gives one row of exact sums for each cluster,
    which Spark adds up; the driver holds k x size integers. A centroid moves to the exact floor of the mean; an empty one stays.

    The first centroids: in the order of sha256(salt + id), ties by the vector itself; null ids come last. With fewer
    than k kept vectors there are as many centroids. Repeated rows count each for itself. Components of any size
    are exact; distances beyond a long's range are the largest long. Other columns don't matter; an
    empty table, or one without kept vectors, gives an empty result and no centroids."""
    spark = vectors.sparkSession
    small_batches(spark)
    fine = F.coalesce((F.size(vector_col) == size) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    kept = vectors.where(fine).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    hashed = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = kept.select("vector", hashed.alias("hash")).orderBy(F.col("hash").asc_nulls_last(), "vector").limit(k).collect()
    whole = DecimalType(38, 0)
    names = [f"s{i}" for i in range(size)]
    if not first:
        return spark.createDataFrame([], f"{id_col} {kept.schema['id'].dataType.simpleString()}, cluster int, distance long"), np.zeros((0, size), np.int64)
    centres = whole_numbers(np.array([r["vector"] for r in first], np.float64))

    def sums(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = [0] * len(now), np.zeros((len(now), size), object)
            for b in batches:
                if b.num_rows:
                    x = _vectors(b.column(0), size)
                    best, _ = nearest(x, now)
                    for c in np.unique(best).tolist():
                        rows = x[best == c]
                        count[c] += len(rows)
                        total[c] += _exact_sums(rows)
            out = []
            for c in range(len(now)):
                if count[c]:
                    left, limb = total[c], 0
                    while True:
                        more = np.array([int(v) >> LIMB for v in left], object)
                        low = [int(v) - (int(m) << LIMB) for v, m in zip(left, more, strict=True)]
                        out.append((c, limb, count[c] if limb == 0 else 0, *low))
                        if all(m in (0, -1) for m in more):
                            out.append((c, limb + 1, 0, *map(int, more)))
                            break
                        left, limb = more, limb + 1
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int32(), pa.int32()] + [pa.int64()] * (size + 1), strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays(columns, names=["cluster", "limb", "n", *names])

        return run

    for _ in range(rounds):
        parts = kept.select("vector").mapInArrow(sums(centres), "cluster int, limb int, n long, " + ", ".join(f"{x} long" for x in names))
        found = parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *(F.sum(F.col(x).cast(whole)).alias(x) for x in names)).collect()
        counts, totals = [0] * len(centres), [[0] * size for _ in centres]
        for r in found:
            counts[r["cluster"]] += r["n"]
            for i, x in enumerate(names):
                totals[r["cluster"]][i] += int(r[x]) << (LIMB * r["limb"])
        moved = [[t // n for t in row] if n else [int(v) for v in old] for row, n, old in zip(totals, counts, centres.tolist(), strict=True)]
        centres = np.array(moved, object) if max(abs(v) for row in moved for v in row) >= 1 << 52 else np.array(moved, np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column(1), size)
            best, _ = nearest(x, centres) if len(x) else (np.zeros(0, np.int64), None)
            distance = [min(int(v), LONG) for v in squared(x, centres[best]).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], names=[id_col, "cluster", "distance"])

    return kept.mapInArrow(assign, f"`{id_col}` {kept.schema['id'].dataType.simpleString()}, cluster int, distance long"), centres


def _exact_sums(rows: np.ndarray) -> np.ndarray:
    """Column sums as Python's integers; halves of 26 bits are added up apart, as the sum of numbers below 2**52 may not fit 64 bits."""
    if rows.dtype != object:
        half = rows >> 26
        high, low = half.sum(axis=0), (rows - (half << 26)).sum(axis=0)
        return np.array([(int(a) << 26) + int(b) for a, b in zip(high, low, strict=True)], object)
    return rows.sum(axis=0)


def with_inertia(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds to centroid_clusters()' rows cluster_inertia and inertia, the distances of a cluster and of all added up, and centroid_sha256.

    The rows are staged, as they are read twice; k rows are joined back. Sums beyond a long's range are the largest long."""
    rows = staged(rows)
    per = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    table = [(c, min(s, LONG), min(sum(per.values()), LONG), hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, s in sorted(per.items())]
    about = rows.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster")

"""Starts of the online inference that tell groups apart."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .posterior import both_ways
from .storage import only_kept, staged


def event_space(ways: DataFrame, nodes: DataFrame, k: int, rounds: int = 6) -> DataFrame:
    """(node, x0 .. x{k-1}): the k main directions of the event matrix A, for nodes with events; ways: its edges from both ends.

    Subspace iteration on A A' + A' A, whose main vectors tell senders and receivers apart together. A round is two joins of the edges
    with the nodes' vectors and an aggregate each; only the k x k products that make the vectors orthonormal are on the driver.
    Vectors are as long as the directions are strong, so that weak ones, which are noise, weigh little."""
    x = staged(nodes.select("node", *((F.pmod(F.xxhash64("node", F.lit(i)), F.lit(1 << 20)) / float(1 << 19) - 1).alias(f"x{i}") for i in range(k))))
    for _ in range(rounds):
        mid = ways.join(x.withColumnRenamed("node", "other"), "other").groupBy("node")
        mid = mid.agg(*(F.expr(f"sum(if({way}, n * x{i}, 0D)) AS {name}{i}") for i in range(k) for name, way in (("o", "out"), ("i", "NOT out"))))
        far = ways.join(mid.withColumnRenamed("node", "other"), "other").groupBy("node")
        y = staged(far.agg(*(F.expr(f"sum(n * if(out, i{i}, o{i})) AS y{i}") for i in range(k))))
        row = y.agg(*(F.expr(f"sum(y{i} * y{j}) AS g{i}_{j}") for i in range(k) for j in range(i, k))).first()
        gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        strength, turn = np.linalg.eigh(gram)
        strength, turn = strength[::-1], turn[:, ::-1]
        sound = strength > 1e-12 * max(strength[0], 1e-300)
        root = np.where(sound, 1 / np.sqrt(np.where(sound, strength, 1.0)), 0.0)
        x = y.select("node", *(F.expr(" + ".join(f"y{i} * {float(turn[i, j] * root[j])!r}D" for i in range(k))).alias(f"x{j}") for j in range(k)))
    long = np.where(sound, np.maximum(strength, 0) ** 0.25, 0.0)  # the lengths of A's own directions
    return staged(x.select("node", *((F.col(f"x{j}") * float(long[j])).alias(f"x{j}") for j in range(k))))


def _apart(space: DataFrame, k: int) -> np.ndarray:
    """k nodes' vectors that lie apart: each the longest of what is left beyond the directions of those before."""
    found, basis = [], np.zeros((0, k))
    for _ in range(k):
        rest = np.eye(k) - basis.T @ basis
        size = " + ".join(f"pow({' + '.join(f'x{i} * {float(rest[i, j])!r}D' for i in range(k))}, 2)" for j in range(k))
        best = space.select(*(f"x{i}" for i in range(k)), F.expr(size).alias("size"), "node").agg(F.max_by(F.struct(*(f"x{i}" for i in range(k))), F.struct("size", -F.col("node"))).alias("x")).first()["x"]
        if best is None:
            break
        point = np.array(best, float)
        left = rest @ point
        found.append(point)
        if np.linalg.norm(left) > 1e-9 * max(np.linalg.norm(point), 1e-300):
            basis = np.vstack([basis, left / np.linalg.norm(left)])
    return np.array(found)


def spectral_shares(counts: DataFrame, nodes: DataFrame, k: int, share: float = 0.9, rounds: int = 6, moves: int = 8) -> DataFrame:
    """tau(node, p0 .. p{k-1}): shares from the main directions of counts(src, dst, n), groups numbered from the largest on.

    Nodes' vectors (see event_space()) go to the nearest of k centres, which begin at vectors that lie apart and move to the mean of
    theirs `moves` times, each an aggregate of k rows. A node gets `share` of its group, the rest evenly; a node without events equal shares.
    The same counts give the same shares, whatever their partitions, but for rounding."""
    with only_kept(nodes.sparkSession) as scope:
        ways = staged(both_ways(counts.select("src", "dst", "n", F.lit(1.0).alias("w"))))
        space = event_space(ways, nodes, k, rounds)
        centres = _apart(space, k)
        names = [f"x{i}" for i in range(k)]

        def grouped(centres: np.ndarray) -> DataFrame:
            far = [" + ".join(f"pow({n} - ({float(v)!r}D), 2)" for n, v in zip(names, c, strict=True)) for c in centres]
            return space.withColumn("grp", F.expr(f"array_position(array({', '.join(far)}), array_min(array({', '.join(far)}))) - 1"))

        order = list(range(k))
        for _ in range(moves if len(centres) else 0):
            rows = grouped(centres).groupBy("grp").agg(F.count("*").alias("size"), *(F.avg(n).alias(n) for n in names)).collect()
            for r in rows:
                centres[r["grp"]] = [r[n] for n in names]
            size = {r["grp"]: r["size"] for r in rows}
            order = sorted(range(len(centres)), key=lambda c: (-size.get(c, 0), c))
        lean = [F.when(F.col("grp").isNull(), 1.0 / k).when(F.col("grp") == c, share if k > 1 else 1.0).otherwise((1 - share) / max(1, k - 1)).alias(f"p{i}") for i, c in enumerate([*order, *range(len(order), k)])]
        labels = grouped(centres).select("node", "grp") if len(centres) else space.select("node", F.lit(None).cast("long").alias("grp"))
        tau = staged(nodes.select("node").join(labels, "node", "left").select("node", *lean))
        scope.keep(tau)
    return tau

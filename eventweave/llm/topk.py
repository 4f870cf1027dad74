"""Exact top-k search by integer inner product: cover trees of queries and data, pruned in pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, staged

NONE = np.iinfo(np.int64).max
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class CoverTree:
    """A cover tree over points: nested balls, each level's radius SHRINK times that of the level above.

    Three things hold at each node that has children: the children's centres are points of the node,
    its own centre among them; each point lies within SHRINK times the node's radius of its child's
    centre; and the centres lie farther apart than that. A node with at most `leaf` points is a leaf,
    and so is one whose points are so far apart that its children would hold fewer than `share` each.
    Points of a node are a stretch of `order`; a node is (lo, hi, centre, radius, greatest norm, children)."""

    SHRINK = 0.6

    def __init__(self, points: np.ndarray, leaf: int, share: int = 4) -> None:
        self.leaf, self.share = leaf, share
        self.points, self.order, self.nodes = points, np.zeros(len(points), np.int64), []
        self.lengths = np.sqrt((points**2).sum(axis=1))
        self.filled = 0
        self.root = self._build(np.arange(len(points)), 0) if len(points) else -1
        self.centres = np.array([n[2] for n in self.nodes])
        self.radii, self.longest = (np.array([n[i] for n in self.nodes]) for i in (3, 4))
        self.norms = np.sqrt((self.centres**2).sum(axis=1)) if self.nodes else np.zeros(0)

    def _distances(self, at: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[at] - centre) ** 2).sum(axis=1))

    def _build(self, at: np.ndarray, head: int) -> int:
        centre = self.points[at[head]]
        distance = self._distances(at, centre)
        radius, lo, children, me = float(distance.max()), self.filled, [], len(self.nodes)
        self.nodes.append(None)
        heads = [head]
        if len(at) > self.leaf and radius > 0:
            # Farthest points become centres until all lie within the children's radius.
            near, owner = distance.copy(), np.zeros(len(at), np.int64)
            while near.max() > self.SHRINK * radius and len(heads) <= len(at) // self.share:
                heads.append(int(near.argmax()))
                d = self._distances(at, self.points[at[heads[-1]]])
                closer = d < near
                near[closer], owner[closer] = d[closer], len(heads) - 1
        if 1 < len(heads) <= len(at) // self.share:
            for k in range(len(heads)):
                part = np.flatnonzero(owner == k)
                children.append(self._build(at[part], int(np.flatnonzero(part == heads[k])[0])))
        else:
            self.order[lo : lo + len(at)] = at
            self.filled += len(at)
        self.nodes[me] = (lo, self.filled, centre, radius, float(self.lengths[at].max()), children)
        return me


def highest_product(product, norm_a, radius_a, longest_a, norm_b, radius_b, longest_b):  # noqa: ANN001, ANN201
    """A bound of the inner products that two balls allow, from the product and norms of their centres.

    The lesser of two: the centres' product and what the radii add; and, as twice a product is the
    squared norms less the squared distance, the longest norms less the least distance. A little more
    is allowed for rounding."""
    apart = np.maximum(0.0, np.sqrt(np.maximum(0.0, norm_a**2 + norm_b**2 - 2 * product)) - radius_a - radius_b)
    far = (longest_a**2 + longest_b**2 - apart**2) / 2
    return np.minimum(product + norm_a * radius_b + norm_b * radius_a + radius_a * radius_b, far) + 1 + 1e-7 * (longest_a + radius_a + longest_b + radius_b) ** 2


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two tables of longs, exact; beyond a long, the nearest long."""
    top = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if top < 2.0**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if top < 2.0**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), LEAST, MOST).astype(np.int64)


def dual_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids, pairs): k for each query, best first, ties to the smaller id; missing ones have id NONE. pairs is the number that was scored.

    A pair of nodes is left out when the highest inner product that their balls allow is below the
    worst k-th score among the queries of the one. least has a score for each query that k candidates
    elsewhere reach: what is below it needn't be found. At two leaves the same goes for each query alone."""
    q, d = CoverTree(queries.astype(float), 8, 2), CoverTree(data.astype(float), 64)
    best, ids, pairs = np.full((len(queries), k), LEAST), np.full((len(queries), k), NONE), 0
    worst = np.full(len(queries), -np.inf) if least is None else least.astype(float)

    def bounds(a: int, others: list[int], at: CoverTree, to: CoverTree) -> np.ndarray:
        product = to.centres[others] @ at.centres[a]
        return highest_product(product, at.norms[a], at.radii[a], at.longest[a], to.norms[others], to.radii[others], to.longest[others])

    stack = [(q.root, d.root, np.inf)] if q.root >= 0 and d.root >= 0 else []
    while stack:
        a, b, high = stack.pop()
        lo, hi, _, ra, _, ca = q.nodes[a]
        mine = q.order[lo:hi]
        if high < worst[mine].min():
            continue
        x, y, _, rb, _, cb = d.nodes[b]
        if not ca and not cb:
            one = highest_product(q.points[mine] @ d.centres[b], q.lengths[mine], 0.0, q.lengths[mine], d.norms[b], rb, d.longest[b])
            mine, theirs = mine[one >= worst[mine]], d.order[x:y]
            scores, pairs = whole_products(queries[mine], data[theirs]), pairs + len(mine) * len(theirs)
            own = query_ids[mine][:, None] == data_ids[theirs]
            scores, more = np.where(own, LEAST, scores), np.where(own, NONE, data_ids[theirs])
            scores, more = np.concatenate([best[mine], scores], axis=1), np.concatenate([ids[mine], more], axis=1)
            order = np.lexsort((more, ~scores), axis=1)[:, :k]  # ~ turns the order of longs round, the least one's too
            best[mine], ids[mine] = np.take_along_axis(scores, order, 1), np.take_along_axis(more, order, 1)
            full = mine[ids[mine, -1] != NONE]
            worst[full] = np.maximum(worst[full], best[full, -1])
        elif not cb or (ca and ra > rb):
            stack += sorted(((c, b, h) for c, h in zip(ca, bounds(b, ca, d, q), strict=True)), key=lambda s: s[2])
        else:
            stack += sorted(((a, c, h) for c, h in zip(cb, bounds(a, cb, q, d), strict=True)), key=lambda s: s[2])
    return best, ids, pairs


def whole_vector(vector: Column, scale: float = 1024.0) -> Column:
    """floor(scale * x) for every component, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _in_cells(rows: DataFrame, pivots: list[np.ndarray]) -> DataFrame:
    """rows with the cell of the nearest pivot of their dimension (-1 without one), the distance to it and their norm."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = len(pdf)
            cell, away, norm = np.full(n, -1), np.zeros(n), np.zeros(n)
            for size, at in pdf.groupby("size").indices.items():
                points = np.stack(pdf["vector"].iloc[at].tolist()).astype(float)
                norm[at] = np.sqrt((points**2).sum(axis=1))
                mine = [i for i, p in enumerate(pivots) if len(p) == size]
                if mine:
                    centres = np.stack([pivots[i] for i in mine])
                    nearest = ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
                    cell[at] = np.array(mine)[nearest]
                    away[at] = np.sqrt(((points - centres[nearest]) ** 2).sum(axis=1))
            yield pdf.assign(cell=cell.astype(np.int32), away=away, norm=norm)

    return rows.mapInPandas(assign, "id long, vector array<long>, query boolean, size int, no long, cell int, away double, norm double")


def top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, shard_rows: int = 4096, query_rows: int = 2048, most_cells: int = 512) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k rows of the highest integer inner product with each query.

    queries is a condition on the rows of vectors. Components become floor(1024 * x). All rows go to
    the cell of the nearest of at most most_cells pivots (rows of the least hashes), and a cell's rows
    to shards of about shard_rows by a hash, so that a cell of any size is split. A query searches its
    own cell first; its k-th score there is the threshold for the other cells, and it goes only to those
    whose ball allows a score as high. A task builds the trees of a shard and of about query_rows queries
    and searches them in pairs. The shards' best are merged in two steps. Nothing is dropped unless its
    bound shows that it can't be among the k. The driver holds the pivots and one row for each cell.

    Ids are whole numbers, of any integer type; columns of other types are an error where they don't cast to one.
    Vectors that are null, or hold null or non-finite components, and null ids take no part.
    Rows that repeat an id and vector are one; candidates exclude every row of the query's id.
    Only vectors of a query's own dimension are its candidates. Ties go to the smaller id. Scores are
    exact; those beyond a long's range are the nearest long. Other columns don't matter; an empty
    table, or one without queries, gives an empty result.
    """
    fine = F.coalesce(F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.withColumn("__query", F.coalesce(queries, F.lit(False))).where(fine & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), whole_vector(F.col(vector_col)).alias("vector"), F.col("__query").alias("query"))
    rows = staged(rows.distinct().withColumns({"size": F.size("vector"), "no": F.xxhash64("id", "vector")}))
    pivots = rows.orderBy("no", "id").limit(max(1, min(most_cells, rows.count() // shard_rows))).select("vector").collect()
    pivots = [np.array(r[0], float) for r in pivots]
    rows = staged(_in_cells(rows, pivots))

    spark = rows.sparkSession
    balls = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("norm").alias("longest")).collect()
    shards = {b["cell"]: -(-b["n"] // shard_rows) for b in balls}
    order = [F.col("score").desc(), F.col("vec_id")]
    found = "query_id long, query_no long, vec_id long, score long, part int"

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        a, d = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if a.empty or d.empty:
            return pd.DataFrame({"query_id": [], "query_no": [], "vec_id": [], "score": [], "part": []})
        q, x = np.stack(a["vector"].tolist()), np.stack(d["vector"].tolist())
        least = a["least"].to_numpy(float, na_value=-np.inf)
        scores, ids, _ = dual_search(q, a["id"].to_numpy(), x, d["id"].to_numpy(), k, least)
        held = ids != NONE
        at = np.nonzero(held)[0]
        return pd.DataFrame({"query_id": a["id"].to_numpy()[at], "query_no": a["no"].to_numpy()[at], "vec_id": ids[held], "score": scores[held], "part": int(pdf["shard"].iloc[0]) % 64})

    def best(near: DataFrame, *by: str) -> DataFrame:
        return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_no", *by).orderBy(*order))).where(F.col("rank") <= k)

    def searched(asks: DataFrame) -> DataFrame:
        """The best of each query in the cells that asks (staged) sends it to: all shards of a cell, its queries in blocks."""
        blocks = {r["cell"]: -(-r["count"] // query_rows) for r in asks.groupBy("cell").count().collect()}
        if not blocks:
            return spark.createDataFrame([], found.replace("part", "rank"))
        plan = F.broadcast(spark.createDataFrame([(c, shards[c], b) for c, b in blocks.items()], "cell int, shards int, blocks int"))
        hashed = lambda of: F.pmod("no", of).cast("int")
        each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        keys = ["cell", "size", "shard", "block"]
        data = rows.join(plan, "cell").withColumns({"asks": F.lit(False), "least": F.lit(None).cast("double"), "shard": hashed("shards")}).withColumn("block", each("blocks"))
        sent = asks.join(plan, "cell").withColumns({"asks": F.lit(True), "block": hashed("blocks")}).withColumn("shard", each("shards"))
        columns = [*keys, "asks", "id", "no", "vector", "least"]
        near = data.select(columns).unionByName(sent.select(columns)).groupBy(*keys).applyInPandas(search, found)
        return best(best(near, "part")).drop("part")

    asks = rows.where("query")
    near = staged(searched(staged(asks.withColumn("least", F.lit(None).cast("double")))))
    # k scores of the own cell set the threshold of the others; with fewer, all cells are searched.
    least = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("query_no").alias("no"), F.col("score").cast("double").alias("least"))
    known = {b["cell"]: b for b in balls if b["cell"] >= 0}

    def elsewhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, at in pdf.groupby("size").indices.items():
                cells = np.array([c for c in sorted(known) if len(pivots[c]) == size], np.int32)
                if len(cells) == 0:
                    continue
                some = pdf.iloc[at]
                points, centres = np.stack(some["vector"].tolist()).astype(float), np.stack([pivots[c] for c in cells])
                length, radius, longest = some["norm"].to_numpy()[:, None], *(np.array([known[c][name] for c in cells]) for name in ("radius", "longest"))
                high = highest_product(points @ centres.T, length, 0.0, length, np.sqrt((centres**2).sum(axis=1)), radius, longest)
                open_to = (high >= some["least"].to_numpy(float, na_value=-np.inf)[:, None]) & (cells != some["cell"].to_numpy()[:, None])
                at_row, at_cell = np.nonzero(open_to)
                if len(at_row):
                    yield some.iloc[at_row].assign(cell=cells[at_cell])

    fields = ["id", "no", "vector", "size", "cell", "norm", "least"]
    asks = asks.join(if_small(least, 100_000), ["id", "no"], "left").select(fields)
    more = searched(staged(asks.mapInPandas(elsewhere, "id long, no long, vector array<long>, size int, cell int, norm double, least double")))
    return best(near.drop("rank").unionByName(more.drop("rank"))).select("query_id", "rank", "vec_id", "score")

"""N-gram Jaccard self-join: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import arrow_type, connected_components, if_small, one_of_repeats, small_batches, staged
from .words import mix, scan

_MUL = np.uint64(0xD6E8FEB86659FD93)


def choose_bands(similarity: float, recall: float, most_hashes: int = 192) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, whose bands reach the recall at that similarity."""
    for rows in range(most_hashes, 0, -1):
        bands = most_hashes // rows
        if 1 - (1 - similarity**rows) ** bands >= recall:
            return bands, rows
    raise ValueError("no bands reach this recall; raise most_hashes")


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its n-grams of words, lower-cased.

    A text of fewer than n words has one n-gram, of them all; a text without words has none."""
    for words in scan([(t or "").lower() for t in texts]):
        h = words.hashes()
        grams = h.copy()
        for k in range(1, n):
            grams = mix(grams[:-1] * _MUL + h[k:])
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                short = h[a : a + 1]
                for k in range(a + 1, b):
                    short = mix(short * _MUL + h[k : k + 1])
                yield short
            else:
                yield h[:0]


def band_keys(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The keys of a set's bands; the number of the band is part of each."""
    rng = np.random.default_rng(20)
    a, b = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) for _ in range(2))
    a |= np.uint32(1)
    x, least = (grams >> np.uint64(32)).astype(np.uint32), None
    for i in range(0, len(x), 1024):
        now = (a[:, None] * x[None, i : i + 1024] + b[:, None]).min(axis=1)
        least = now if least is None else np.minimum(least, now)
    least = least.astype(np.uint64).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        key = mix(key * _MUL + least[:, k])
    return key.view(np.int64)


def _signatures(n: int, bands: int, rows: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, keys, last = [], [], {}
            for grams in shingle_sets(b.column(1).to_pylist(), n):
                node = hashlib.blake2b(grams.tobytes(), digest_size=15).hexdigest() if len(grams) else None
                nodes.append(node)
                if node and node not in last:
                    last = {node: band_keys(grams, bands, rows)}
                keys.append(last[node] if node else None)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(nodes, pa.string()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return run


def _block_links(similarity: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """All similar pairs between two blocks (or within one), told as counts per node and a spanning forest."""
        pdf = pdf.sort_values(["block", "node"]).reset_index(drop=True)
        sets = [np.asarray(x) for x in pdf["grams"]]
        sizes, m = np.array([len(x) for x in sets]), len(sets)
        ids, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        owner, common = np.repeat(np.arange(m), sizes), np.zeros((m, m), np.float32)
        order = np.argsort(inverse, kind="stable")
        inverse, owner = inverse[order], owner[order]
        for at in range(0, len(ids), 16384):  # columns of the incidence matrix, a few at a time
            lo, hi = np.searchsorted(inverse, [at, at + 16384])
            x = np.zeros((m, min(16384, len(ids) - at)), np.float32)
            x[owner[lo:hi], inverse[lo:hi] - at] = 1
            common += x @ x.T
        exact = common.astype(np.float64)  # counts under 2**24: exact in float32
        alike = (exact > 0) & (exact >= similarity * (sizes[:, None] + sizes - exact) - 1e-9)
        np.fill_diagonal(alike, False)
        block = pdf["block"].to_numpy()
        if key[1] != key[2]:
            alike &= block[:, None] != block
        copies, nodes = pdf["copies"].to_numpy(), pdf["node"].to_numpy()
        edges, seen = [], np.zeros(m, bool)
        for root in range(m):
            stack = [] if seen[root] else [root]
            seen[root] = True
            while stack:
                i = stack.pop()
                for j in np.flatnonzero(alike[i] & ~seen):
                    seen[j] = True
                    stack.append(j)
                    edges.append((nodes[i], nodes[j], 0))
        linked = np.flatnonzero(alike.any(axis=1))
        counts = [(nodes[i], None, int(copies[alike[i]].sum())) for i in linked]
        return pd.DataFrame(edges + counts, columns=["a", "b", "links"])

    return run


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: id, class_id, class_size and links.

    links: how many other rows have an n-gram Jaccard similarity of at least `similarity` with it.
    class_id: the least id of the rows that links join, directly or through others.

    Rows with one n-gram set are one node, so copies are never paired. Bands come from
    choose_bands(); nodes meet in a shuffle on band keys. Buckets of up to `bucket` nodes give
    pairs. Larger ones are joined into components, whose nodes are compared block by block, each
    pair of blocks a task that returns counts and a spanning forest, never its pairs; this is the
    exact way for hot buckets, with no cap. Every link is verified on full n-gram sets.

    options are those of classes(). Null and empty texts, and those of white space, have no n-grams: no links, a class each. A
    text of fewer than n words is one n-gram. Repeated rows are copies; with a null id they count,
    but never name a class unless it has no other id. Other columns don't matter; an empty table
    gives an empty result. Texts of any length count whole.
    """
    return classes(docs, id_col, text_col, **options).select(id_col, "class_id", "class_size", "links")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), n: int = 5, similarity: float = 0.8, recall: float = 0.9999, most_hashes: int = 192, bucket: int = 32, block: int = 128, broadcast_rows: int = 200_000) -> DataFrame:
    """What ngram_join() returns, with the extra columns and class: a name that no two classes share (null: a row alone)."""
    small_batches(docs.sparkSession)
    bands, rows = choose_bands(similarity, recall, most_hashes)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"), *(F.col(c).alias(f"__x{i}") for i, c in enumerate(extra)))
    out = source.drop("__text").schema.add("node", "string").add("keys", ArrayType(LongType()))
    schema = pa.schema([("id", arrow_type(source, "id")), *((f"__x{i}", arrow_type(source, f"__x{i}")) for i in range(len(extra))), ("node", pa.string()), ("keys", pa.list_(pa.int64()))])
    signed = staged(source.mapInArrow(_signatures(n, bands, rows, schema), out))

    nodes = staged(signed.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("keys").alias("keys")))
    members = nodes.select("node", F.explode("keys").alias("key"))
    full = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1")
    members = staged(members.join(staged(full), "key"))  # two plain shuffles, which AQE splits at hot keys

    hot = members.where(F.col("n") > bucket)
    groups = staged(connected_components(hot.select(F.col("head").alias("a"), F.col("node").alias("b"))))
    small = members.where(F.col("n") <= bucket).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("in"))
    pairs = small.select(F.posexplode("in").alias("i", "a"), "in").select("a", F.explode(F.expr("slice(in, i + 2, size(in))")).alias("b")).distinct()
    left, right = (groups.select(F.col("node").alias(x), F.col("component").alias(f"__{x}")) for x in "ab")
    pairs = staged(pairs.join(left, "a", "left").join(right, "b", "left").where("not coalesce(__a = __b, false)").select("a", "b"))

    wanted = staged(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(groups.select("node")).distinct())
    # One row of each wanted node is read again for its set; only ids, not texts, decide which.
    keep = wanted.join(nodes.select("node", "least"), "node").select(F.col("least").alias("__least"), "node")
    texts = source.join(if_small(keep, broadcast_rows), F.col("id").eqNullSafe(F.col("__least"))).select("node", "__text")
    sets = texts.mapInArrow(_checked_sets(n), "node string, grams array<long>").dropDuplicates(["node"])
    sets = staged(sets)

    one, two = (sets.select(F.col("node").alias(x), F.col("grams").alias(f"grams_{x}")) for x in "ab")
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    alike = pairs.join(one, "a").join(two, "b").withColumn("both", both)
    alike = alike.where(F.col("both") >= similarity * (F.size("grams_a") + F.size("grams_b") - F.col("both")) - 1e-9).select("a", "b")

    # Nodes in a hot component by size of their sets: blocks of about `block` of like size meet only where sizes allow the similarity.
    weight = nodes.select("node", "copies")
    sized = groups.join(sets, "node").withColumn("size", F.size("grams"))
    blocks = _size_blocks(sized.select("component", "node", "size"), block)
    spans = staged(blocks.groupBy("component", "block").agg(F.min("size").alias("low"), F.max("size").alias("high")))
    mine, theirs = (spans.select("component", *(F.col(c).alias(f"{c}_{x}") for c in ("block", "low", "high"))) for x in "ab")
    meets = mine.join(theirs, "component").where("block_a <= block_b").where(F.least("high_a", "high_b") >= similarity * F.greatest("low_a", "low_b") - 1e-9)
    meets = staged(meets.select("component", F.col("block_a").alias("lo"), F.col("block_b").alias("hi")))
    asked = meets.select("component", F.col("lo").alias("block"), "lo", "hi").union(meets.where("lo < hi").select("component", F.col("hi").alias("block"), "lo", "hi"))
    spread = blocks.select("component", "node", "block").join(asked, ["component", "block"]).join(sets, "node").join(weight, "node")
    told = staged(spread.groupBy("component", "lo", "hi").applyInPandas(_block_links(similarity), "a string, b string, links long"))

    alike = staged(alike)
    joined = connected_components(alike.union(told.where("b is not null").select("a", "b")))
    halves = alike.union(alike.select("b", "a")).join(weight.withColumnRenamed("node", "b"), "b").select("a", F.col("copies").alias("links"))
    links = halves.union(told.where("b is null").select("a", "links")).groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    per_node = nodes.select("node", "least", "copies").join(joined, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per_class = per_node.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    per_node = per_node.join(per_class, "component").select("node", "component", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    per_node = staged(per_node.where("class_size > 1"))
    # Nodes alone in their class need no join.
    out = signed.drop("keys").join(if_small(per_node, broadcast_rows), "node", "left")
    alone = F.col("class_size").isNull()
    return out.select(F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.col("component").alias("class"), *(F.col(f"__x{i}").alias(c) for i, c in enumerate(extra)))


def _size_blocks(nodes: DataFrame, block: int) -> DataFrame:
    """Adds block: numbers that rise with size, of about `block` nodes each; a size that more nodes share has blocks of its own.

    Counts of sizes are added up over a component's sizes, which are no more than its longest text has words."""
    counts = nodes.groupBy("component", "size").count()
    before = F.sum("count").over(Window.partitionBy("component").orderBy("size")) - F.col("count")
    counts = staged(counts.select("component", "size", before.alias("before"), "count"))
    within = F.pmod(F.xxhash64("node"), F.col("count"))
    return staged(nodes.join(counts, ["component", "size"]).select("component", "node", "size", F.floor((F.col("before") + within) / block).alias("block")))


def _checked_sets(n: int):
    """Sets of rows (node, text); a row whose text is not the node's, as ids may repeat, is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(node, x.view(np.int64)) for node, x in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist(), n), strict=True) if hashlib.blake2b(x.tobytes(), digest_size=15).hexdigest() == node]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.list_(pa.int64()))], names=["node", "grams"])

    return run


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs of each class of rows that links join: that with the least id (nulls last), of these with the least hash of its text.

    All columns are kept. Rows decide by id and text together, so an unrelated text of an id that
    goes stays. Of rows that repeat both, one stays; which of their other columns stay isn't said.
    Null and empty texts are near nothing; an empty table gives an empty result."""
    docs = one_of_repeats(docs, id_col, text_col)
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = classes(docs.select(F.col(id_col), F.col(text_col), text.alias("__hash")), id_col, text_col, ("__hash",), **options).where("class is not null")
    rows = staged(rows.select("class", F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.col("__hash").alias("hash")).alias("row")))
    stay = staged(rows.groupBy("class").agg(F.min("row").alias("stay")))
    gone = staged(rows.join(if_small(stay, 200_000), "class").where("row <> stay").select(F.col("row.id").alias("__gone"), F.col("row.hash").alias("__hash")))
    return docs.join(if_small(gone, 1_000_000), F.col(id_col).eqNullSafe(F.col("__gone")) & (text == F.col("__hash")), "left_anti")

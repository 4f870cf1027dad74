"""Exact deduplication by progressive refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, if_small, mark_perhaps, staged


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, broadcast_rows: int = 100_000, names: tuple[str, str, str] = ("keep_id", "group_size", "kept")) -> DataFrame:
    """Adds keep_id, group_size and kept (or other names) to every row of docs.

    Groups by length, then by the hash of the first prefix_chars characters, then by the
    SHA-256 of the whole text, which is worked out only for rows whose length and prefix
    another row has too. The tables of surviving keys are aggregates; they are broadcast
    after a count shows at most broadcast_rows of them, so that texts are not shuffled. Beyond that they are
    joined by shuffle (which AQE splits where skewed), but only rows that a bitmap of the surviving keys doesn't
    rule out take part; the texts of all others stay where they are.

    Texts are equal when identical after lower-casing A-Z; of equal ones the row with the
    largest id stays. Null text counts as empty. Null ids are the least; a group of null ids
    only keeps null. Rows that repeat an id and its text share its verdict. Columns named
    like the results are replaced; an empty table gives an empty result. Texts may be of any length: only their hashes meet.
    """
    docs = docs.drop(*names)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({"__len": F.octet_length(text), "__pre": F.xxhash64(ascii_lower(F.substring(text, 1, prefix_chars)))})

    lengths = staged(rows.groupBy("__len").count().where("count > 1").select("__len"))
    prefixes = rows.join(if_small(lengths, broadcast_rows), "__len", "left_semi").groupBy("__len", "__pre").count()
    prefixes = staged(prefixes.where("count > 1").select("__len", "__pre", F.lit(True).alias("__read")))
    alone = None
    if prefixes.limit(broadcast_rows + 1).count() > broadcast_rows:
        both = F.xxhash64("__len", "__pre").alias("__both")
        rows = mark_perhaps(rows.select("*", both), prefixes.select(both), "__both").drop("__both")
        alone, rows = rows.where("not __perhaps"), rows.where("__perhaps")
    rows = rows.join(if_small(prefixes, broadcast_rows), ["__len", "__pre"], "left")

    # Rows read no further get a key of their own, so that they don't meet in one partition.
    single = F.concat(F.lit("-"), F.xxhash64(F.col(id_col), "__len", "__pre").cast("string"))
    rows = rows.withColumn("__key", F.when(F.col("__read"), F.sha2(ascii_lower(text), 256)).otherwise(single))
    groups = rows.where("__read").groupBy("__key").agg(F.max(id_col).alias("__keep"), F.count("*").alias("__size"))
    groups = staged(groups.where("__size > 1"))
    rows = rows.join(if_small(groups, broadcast_rows), "__key", "left")
    keep = F.when(F.col("__size").isNull(), F.col(id_col)).otherwise(F.col("__keep"))
    results = [keep, F.coalesce("__size", F.lit(1).cast("long")), F.col(id_col).eqNullSafe(keep)]
    out = rows.select(*docs.columns, *(x.alias(n) for x, n in zip(results, names, strict=True)))
    if alone is None:
        return out
    own = [F.col(id_col), F.lit(1).cast("long"), F.lit(True)]
    return out.unionByName(alone.select(*docs.columns, *(x.alias(n) for x, n in zip(own, names, strict=True))))

"""From raw documents to packed sequences: five stages, each one of the operators in eventweave.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the
shared folder and reads again for the next. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.llm.common import if_small, mark_perhaps, one_of_repeats, staged
from eventweave.llm.exact_dedup import exact_dedup
from eventweave.llm.mixing import mix_sources
from eventweave.llm.ngram_join import one_of_each
from eventweave.llm.packing import pack
from eventweave.llm.quality import score_quality, train_quality

#: The classifier, the mixing and the packing can't be said in SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score at least 0.3; learned from labelled documents that aren't held out.

    Null and empty texts get the score of the bias and go or stay together; a tie at 0.3 stays; repeated rows share
    their score; texts of any length are read whole; an empty table gives an empty result; other columns, one named score too, are kept."""
    weights = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, weights, score_col="__score").where("__score >= 0.3").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the one with the largest id. Of rows that repeat an id and its text one stays too.

    Null text is equal to empty text; null ids are the least; texts of any length meet as hashes only; other columns, those
    named like the operator's results too, are kept; an empty table gives an empty result."""
    kept = staged(exact_dedup(docs, names=("__keep", "__size", "__kept")).where("__kept").select(docs.columns))
    return one_of_repeats(kept, "doc_id", "text")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies: the one with the least id.

    Null and empty texts are near nothing and stay; ties, repeated rows, very long texts, other columns and empty tables: see one_of_each()."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as the mix takes it (none to three times).

    Rows count each for itself, also where they share an id; rows alike in all columns share what the mix takes of them
    together. Null and empty texts have no words, so the mix takes as many of them as of their source; null ids are ids like
    others; texts of any length count whole; other columns are kept; an empty table gives an empty result."""
    row = F.xxhash64(*docs.columns)
    copies = mix_sources(docs.select("doc_id", "source", "text", row.alias("__row")), extra=("__row",))
    copies = staged(copies.groupBy(F.col("doc_id").alias("__id"), "__row").agg(F.sum("copies").cast("int").alias("__copies"), F.count("*").alias("__same")))
    # Most rows are taken once: a bitmap of the others' hashes leaves their texts where they are, and the others' numbers are joined.
    other = staged(copies.where("__copies <> __same"))
    marked = mark_perhaps(docs.withColumn("__hash", row), other.select(F.col("__row").alias("__hash")), "__hash")
    once, some = marked.where("not __perhaps").select(docs.columns), marked.where("__perhaps").select(docs.columns)
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (row == F.col("__row"))
    alike, apart = if_small(other.where("__same > 1"), 200_000), if_small(other.where("__same = 1"), 200_000)
    rows = some.join(alike, on, "left_anti").join(apart, on, "left").select(*docs.columns, "__copies")
    rows = rows.unionByName(some.join(alike, on, "left_semi").dropDuplicates().join(alike, on).select(*docs.columns, "__copies"))
    rows = rows.unionByName(once.withColumn("__copies", F.lit(1)))
    return rows.withColumn("__n", F.explode(F.array_repeat(F.lit(1), F.coalesce("__copies", F.lit(1))))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of 4096 tokens.

    Null and empty texts are one token; each of repeated rows and of null ids is packed for itself; ties and very long texts: see
    pack(); other columns don't matter; an empty table gives an empty result."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources to target weights", mixing), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

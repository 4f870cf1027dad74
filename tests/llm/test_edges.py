"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from eventweave.llm.chat import rotate_perspectives
from eventweave.llm.exact_dedup import exact_dedup
from eventweave.llm.mixing import mix_sources
from eventweave.llm.ngram_join import ngram_join, one_of_each
from eventweave.llm.packing import pack
from eventweave.llm.pii_crf import find_pii
from eventweave.llm.quality import score_quality, train_quality
from eventweave.llm.substring import shared_passages
from eventweave.llm.token_counts import count_with_edits
from eventweave.llm.topk import top_k

LONG = " ".join(f"word{i} and" for i in range(9000))
ROWS = [(1, "Hello there, my old friend", "a"), (2, "hello there, my OLD friend", None), (3, None, "a"), (4, "", "b"), (5, LONG, "b"), (5, LONG, "b"), (None, "no id here at all", None), (None, None, None), (6, " \n\t ", "c"), (7, "one", "c"), (8, LONG + " tail", "c")]
#: Names that operators use for results or inside.
CLASH = ["keep_id", "kept", "KEPT", "group_size", "score", "size", "taken", "target", "copies", "links", "class_id", "node", "id", "block", "length", "piece", "start", "rank", "p", "whole", "other", "__len", "__id", "__key", "__text", "count", "base"]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def clashing(df, keep=()):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in keep and c != "KEPT"})


EDITS = "array(named_struct('at', 2, 'delete', 3, 'insert', 'zz'), named_struct('at', int(null), 'delete', 1, 'insert', string(null)))"
OPERATORS = {
    "exact_dedup": lambda d: exact_dedup(d).select("doc_id", "keep_id", "group_size", "kept"),
    "mixing": lambda d: mix_sources(d),
    "ngram_join": lambda d: ngram_join(d),
    "one_of_each": lambda d: one_of_each(d).select("doc_id", "text"),
    "packing": lambda d: pack(d, P.path("word_bpe_49k.json")),
    "pii": lambda d: find_pii(d),
    "substring": lambda d: shared_passages(d),
    "quality": lambda d: score_quality(d, train_quality(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))).select("doc_id", "score"),
    "token_counts": lambda d: count_with_edits(d.withColumn("edits", F.when(F.col("doc_id") != 7, F.expr(EDITS))), P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
}


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, name):
    run = OPERATORS[name]
    plain, other = rows_of(run(docs(spark))), rows_of(run(clashing(docs(spark))))
    assert plain == other
    if name not in ("packing", "substring", "one_of_each"):
        assert len(plain) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](docs(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_only_null_rows(spark, name):
    out = OPERATORS[name](docs(spark, [(None, None, None), (None, None, None)])).collect()
    assert len(out) == {"substring": 0, "one_of_each": 1}.get(name, 2)  # rows that repeat id and text are one there


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, speaker string, n int"
    rows = [(1, 0, "user", "a <|im_end|>", "x", 1), (1, 0, "user", "a <|im_end|>", "x", 1), (1, None, None, None, "x", 1), (None, 1, " ", "b", "x", 1), (2, 0, "system", "only", "x", 1)]
    out = rotate_perspectives(spark.createDataFrame(rows, schema)).collect()
    assert {(r.conv_id, r.speaker) for r in out} == {(1, "user"), (1, "unknown"), (None, "unknown")}
    assert sum(r.conv_id == 1 for r in out) == 6
    assert "".join(r.rendered for r in out).count("<|im_end|>") == len(out)
    assert rotate_perspectives(spark.createDataFrame([], schema)).collect() == []


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.25]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [None, 1.0]), (None, [9.0, 9.0]), (7, [1.0]), (8, [0.5, -3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    out = top_k(table, F.col("vec_id") % 100 == 0)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in out.orderBy("rank").collect()] == [(100, 1, 1, 524288), (100, 2, 2, 524288), (100, 3, 8, 524288)]
    assert top_k(table.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    big = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e3, 1.0])], "vec_id long, embedding array<double>")
    assert top_k(big, F.col("vec_id") == 0).first().score == 1024 * 10**9 * 1024 * 1000 + 1024 * 1024
    # Neighbouring scores beyond 2**53: 2**20 times 2**40 + 1, 2**40 and 2**40 + 2, and beyond a long.
    odd = [(0, [1024.0, 0.0]), (5, [2.0**30 + 2**-10, 0.0]), (6, [2.0**30, 0.0]), (7, [2.0**30 + 2**-9, 0.0]), (8, [2.0**42, 0.0]), (9, [2.0**41, 0.0])]
    out = top_k(spark.createDataFrame(odd, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in out] == [(8, 2**63 - 1), (9, 2**63 - 1), (7, 2**20 * (2**40 + 2)), (5, 2**20 * (2**40 + 1)), (6, 2**60)]
    empty = spark.createDataFrame([(0, []), (1, [])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in top_k(empty, F.col("vec_id") == 0).collect()] == [(1, 0)]


def test_very_long_texts_in_chat_and_token_counts(spark):
    text = "wide " * 300_000
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "bot", "short")], "conv_id long, turn long, role string, text string")
    out = {(r.speaker, r.position): r for r in rotate_perspectives(turns).collect()}
    assert len(out) == 4 and out["user", 0].rendered == f"<|im_start|>assistant\n{text}<|im_end|>\n" and out["bot", 1].seg_start == len(out["bot", 0].rendered)
    edits = "array(named_struct('at', 700000, 'delete', 5, 'insert', 'X'))"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("edits", F.expr(edits))
    row = count_with_edits(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).first()
    after = spark.createDataFrame([(1, text[:700_000] + "X" + text[700_005:])], "doc_id long, text string").withColumn("edits", F.expr(edits))
    assert row.tokens_after == count_with_edits(after, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).first().tokens and row.chars_encoded < 1000


def test_mixing_of_many_rows_with_one_id_and_size(spark):
    rows = spark.createDataFrame([(None, None, "a")] * 3000 + [(1, "two words", "a")] * 2000 + [(2, "three words here", "b")], "doc_id long, text string, source string")
    out = mix_sources(rows).collect()
    assert len(out) == 5001 and all(r.taken <= 3 * r.size for r in out)
    taken = {s: sum(r.taken for r in out if (r["size"] == 3) == (s == "b")) for s in "ab"}
    target = {s: next(r.target for r in out if r["size"] == (3 if s == "b" else 2)) for s in "ab"}
    assert all(abs(taken[s] - target[s]) <= 3 for s in "ab")

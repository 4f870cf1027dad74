"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import rotate_perspectives

    return rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import shared_passages

    return shared_passages(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    digest = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    rows = exact_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", digest.alias("text_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import held_out, score_quality, train_quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train_quality(docs, _table(spark, sf_dir, "labels"))
    return score_quality(docs, weights).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(_table(spark, sf_dir, "documents"))


def _is(kind: str, x: Column) -> Column:
    return x["kind"] == kind


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii_crf import KINDS, find_pii

    rows = find_pii(_table(spark, sf_dir, "documents"))
    order = lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("order"), x["end"].alias("end"), x["kind"].alias("kind"))
    joined = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, order)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.size(F.filter("base", functools.partial(_is, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))


#: What the edits of op10 put in.
INSERTS = ("", " an added phrase", "2024", "\n\nNew line. ", "'ll")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four edits of every document, at places that its id and length give: deletions, insertions and replacements."""
    import public_tokenizers

    from .token_counts import count_with_edits

    docs = with_edits(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return count_with_edits(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def with_edits(docs: DataFrame) -> DataFrame:
    """docs with the edits of op10."""
    place = lambda i: F.pmod(F.xxhash64("doc_id", i, F.length("text")), F.coalesce(F.length("text"), F.lit(0)) + 1).cast("int")
    size = lambda i: F.pmod(F.xxhash64(i, "doc_id"), F.lit(40)).cast("int")
    insert = lambda i: F.element_at(F.array(*map(F.lit, INSERTS)), (F.pmod(F.xxhash64("doc_id", i), F.lit(len(INSERTS))) + 1).cast("int"))
    edits = F.transform(F.array(*map(F.lit, range(4))), lambda i: F.struct(place(i).alias("at"), size(i).alias("delete"), insert(i).alias("insert")))
    return docs.withColumn("edits", edits)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_automaton import bpe_decode, bpe_encode

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe_decode(bpe_encode(_table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import centroid_clusters, with_inertia

    rows = with_inertia(*centroid_clusters(_table(spark, sf_dir, "embeddings")))
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie, rebuilt

    rows = prefix_trie(*rebuilt(_table(spark, sf_dir, "conversations")))
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {k: f for k, f in globals().items() if k.startswith("op") and "_" in k and callable(f)}
    return {k: named[k] for k in sorted(named, key=lambda k: int(k[2:].split("_")[0]))} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": CHAT_SQL, "op3_exact_dedup": EXACT_DEDUP_SQL, "op7_topk": TOPK_SQL, "op12_centroids": centroids_sql(), "op13_prefix_trie": PREFIX_TRIE_SQL}


EXACT_DEDUP_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""

CHAT_SQL = """
WITH rows AS (
  SELECT conv_id AS conv, turn, translate(CASE WHEN regexp_full_match(coalesce(role, ''), '[ \\t\\n\\x0B\\f\\r]*') THEN 'unknown' ELSE replace(role, '<|', '< |') END, chr(13) || chr(10), '  ') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
speakers AS (SELECT DISTINCT conv, role AS speaker FROM rows WHERE role <> 'system'),
views AS (
  SELECT r.*, speaker, role = speaker AS own,
         CASE WHEN role = speaker THEN '<|im_start|>assistant' || chr(10) WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || role || chr(10) END AS head
  FROM rows r JOIN speakers s ON r.conv IS NOT DISTINCT FROM s.conv),
parts AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM views),
placed AS (
  SELECT *, length(rendered) AS size, row_number() OVER w AS no, sum(length(rendered)) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM parts WINDOW w AS (PARTITION BY conv, speaker ORDER BY turn NULLS LAST, role, text))
SELECT conv AS conv_id, speaker, CAST(no - 1 AS BIGINT) AS position, turn, role, rendered, CAST(upto - size AS BIGINT) AS seg_start, CAST(upto AS BIGINT) AS seg_end,
       own AS trained, CAST(CASE WHEN own THEN upto - size + length(head) END AS BIGINT) AS mask_start, CAST(CASE WHEN own THEN upto - 1 END AS BIGINT) AS mask_end
FROM placed
"""

TOPK_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, q.v AS qv, d.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""


def centroids_sql(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """One table of centroids (c) and of assignments (a) for each round."""
    far = f"list_sum(list_transform(range(1, {size + 1}), lambda i: CAST((v.v[i] - c.v[i]) * (v.v[i] - c.v[i]) AS HUGEINT)))"
    parts = [f"""
v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v, row_number() OVER () AS no FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT {k}))"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
  SELECT no, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d * {k} + c) % {k} AS c, min(d * {k} + c) // {k} AS d
  FROM (SELECT v.no, v.vec_id, v.v, c.c, {far} AS d FROM v, c{i} c) GROUP BY no)""")
        if i < rounds:
            parts.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
    FROM (SELECT a.c, i, sum(a.v[i]) AS s, count(*) AS n FROM a{i} a, range(1, {size + 1}) t(i) GROUP BY a.c, i) GROUP BY c) m ON m.c = c.c)""")
    return f"""WITH {",".join(parts)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c
"""


#: crc32 is worked out bit by bit.
PREFIX_TRIE_SQL = """
WITH t AS MATERIALIZED (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, key) - 1 AS no, key, bytes
  FROM (SELECT conv_id AS c, turn, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, strlen(coalesce(text, '')) AS bytes
        FROM conversations WHERE conv_id IS NOT NULL)),
convs AS MATERIALIZED (
  SELECT c, c - c % 5 AS r, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda crc, x: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda y, i: xor(y >> 1, 3988292384::BIGINT * (y & 1)), xor(crc, x)), 4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT c FROM t)),
turns AS MATERIALIZED (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, no) AS d, key, bytes FROM (
    SELECT k.c, 0 AS own, t.no, t.key, t.bytes FROM convs k JOIN t ON t.c = k.r AND t.no < k.h
    UNION ALL SELECT k.c, 1, t.no, t.key, t.bytes FROM convs k JOIN t ON t.c = k.c AND t.no >= k.h)),
members AS MATERIALIZED (
  SELECT a.c, a.d, any_value(a.bytes) AS bytes, string_agg(b.key, '' ORDER BY b.d) AS p, coalesce(string_agg(b.key, '' ORDER BY b.d) FILTER (b.d < a.d), '') AS q
  FROM turns a JOIN turns b ON a.c = b.c AND b.d <= a.d GROUP BY a.c, a.d
  UNION ALL SELECT c, 0, 0, '', NULL FROM convs),
nodes AS MATERIALIZED (SELECT p, any_value(q) AS q, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved FROM members GROUP BY p),
kids AS (SELECT q, count(*) AS n FROM nodes WHERE q IS NOT NULL GROUP BY q),
ends AS (SELECT p, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS h FROM (SELECT c, arg_max(p, d) AS p FROM members GROUP BY c) GROUP BY p),
below AS (SELECT DISTINCT a.p, b.p AS low FROM members a JOIN members b ON a.c = b.c AND a.d <= b.d),
sums AS (SELECT b.p, sum(n.saved) AS saved, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves FROM below b JOIN nodes n ON n.p = b.low LEFT JOIN kids k ON k.q = b.low GROUP BY b.p)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.p = n.p LEFT JOIN nodes u ON u.p = n.q LEFT JOIN kids k ON k.q = n.p LEFT JOIN ends e ON e.p = n.p
"""

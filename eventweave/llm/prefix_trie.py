"""The trie of conversations' beginnings, as intervals of a preorder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums, staged

#: Prefixes are told apart by their depth and two sums modulo this prime.
PRIME = (1 << 61) - 1
NODE = ["depth", "p1", "p2"]


def _bits(hex_digest: Column, half: int) -> Column:
    """60 bits of a digest, as a long."""
    return F.conv(F.substring(hex_digest, 1 + 15 * half, 15), 16, 10).cast("long")


def _times(a: Column, b: Column) -> Column:
    """a b modulo PRIME, for longs below 2**61; exact, as the product has 37 digits."""
    return ((a.cast("decimal(19,0)") * b.cast("decimal(19,0)")) % F.lit(PRIME).cast("decimal(19,0)")).cast("decimal(19,0)")


def rebuilt(turns: DataFrame, period: int = 5, heads: int = 9, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of conversations that begin like another: turns(c, depth, a1, a2, bytes) and convs(c).

    Conversation c begins with the first h turns of conversation c - c % period (h = crc32 of c % heads), and goes on with its own
    after the first h. A turn is 120 bits of the SHA-256 of its role and text, and the text's size in bytes; texts aren't shuffled."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = rows.select("c", "turn", _bits(F.col("digest"), 0).alias("a1"), _bits(F.col("digest"), 1).alias("a2"), "bytes", F.monotonically_increasing_id().alias("row"))
    rows = staged(prefix_sums(rows, ["c"], ["turn", "a1", "a2", "row"], {"no": F.lit(1)}).select("c", "no", "a1", "a2", "bytes"))
    head = F.collect_list(F.when(F.col("no") < heads, F.struct("no", "a1", "a2", "bytes")))
    convs = rows.groupBy("c").agg(F.max("no").alias("n"), F.sort_array(head).alias("head"))
    convs = staged(convs.withColumns({"root": F.col("c") - F.col("c") % period, "h": (F.crc32(F.col("c").cast("string").cast("binary")) % heads).cast("int")}))
    first = convs.select(F.col("c").alias("root"), "head")
    convs = staged(convs.drop("head").join(first, "root", "left").select("c", "h", F.slice(F.coalesce("head", F.array().cast(convs.schema["head"].dataType)), F.lit(1), F.col("h")).alias("head")).withColumn("had", F.size("head")))
    begin = convs.select("c", F.explode("head").alias("x")).select("c", F.col("x.no").cast("long").alias("depth"), "x.a1", "x.a2", "x.bytes")
    rest = rows.join(convs.select("c", "h", "had"), "c").where("no > h").select("c", (F.col("no") - F.col("h") + F.col("had")).cast("long").alias("depth"), "a1", "a2", "bytes")
    return begin.unionByName(rest), convs.select("c")


def _members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, depth, p1, p2, q1, q2, bytes): every beginning of every conversation; p: its sums, q: those of its parent.

    The sums are of each turn's bits times bits that a hash of its depth gives, so a conversation of any length is added up in parts."""
    weight = F.sha2(F.col("depth").cast("string"), 256)
    rows = turns.withColumn("weight", weight).withColumns({f"t{i + 1}": _times(F.col(f"a{i + 1}"), _bits(F.col("weight"), i)) for i in (0, 1)}).select("c", "depth", "bytes", "t1", "t2")
    rows = prefix_sums(rows, ["c"], ["depth"], {"p1": F.col("t1"), "p2": F.col("t2")})
    prime = F.lit(PRIME).cast("decimal(38,0)")
    sums = {f"{x}{i}": (v % prime).cast("long") for i in (1, 2) for x, v in (("p", F.col(f"p{i}")), ("q", F.col(f"p{i}") - F.col(f"t{i}")))}
    top = convs.select("c", F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(x) for x in ("p1", "p2")), *(F.lit(None).cast("long").alias(x) for x in ("q1", "q2")), F.lit(0).cast("long").alias("bytes"))
    return staged(rows.select("c", "depth", *(sums[x].alias(x) for x in ("p1", "p2", "q1", "q2")), "bytes").unionByName(top))


def _sections(nodes: DataFrame) -> DataFrame:
    """(rep, top, bottom, up, q1, q2, key): nodes with the same least member are a path, its section.

    up: the section that it branches from. key: for every section on the way from the root, where it branches off, deeper ones first,
    and its member. So in order of keys, nodes of a section coming from the top down, every subtree is in one piece."""
    found = nodes.groupBy("rep").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.min_by(F.struct("q1", "q2"), "depth").alias("q"))
    found = staged(found.select("rep", "top", "bottom", "q.q1", "q.q2"))
    parents = nodes.select((F.col("depth") + 1).alias("top"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("rep").alias("up"))
    found = found.join(parents, ["top", "q1", "q2"], "left")
    step = F.array(F.struct((-F.col("top")).alias("after"), F.col("rep").alias("member")))
    found = staged(found.withColumns({"way": F.col("up"), "key": step}))
    # Ways to the root double in length each round.
    while not (open_ := found.where("way is not null")).isEmpty():
        longer = found.select(F.col("rep").alias("way"), F.col("way").alias("next"), F.col("key").alias("before"))
        moved = open_.join(longer, "way").select("rep", "top", "bottom", "q1", "q2", "up", F.col("next").alias("way"), F.concat("before", "key").alias("key"))
        found = staged(found.where("way is null").select(moved.columns).unionByName(moved))
    return found.drop("way")


def _end_hashes(ends: DataFrame, piece: int = 20_000) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of ends(c, depth, p1, p2): the ids at a node in order, joined by commas.

    Sorted by range, so that a node's ids are joined in pieces by many tasks; a task then hashes a node's pieces as they come, without holding them together."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, no = None, [], 0

        def row(last: tuple, ids: list, no: int) -> tuple:
            return *last, no, ids[0], ",".join(map(str, ids))

        for b in batches:
            out = []
            for *node, c in zip(*(b.column(x).to_pylist() for x in (*NODE, "c")), strict=True):
                if ids and (node != held or len(ids) >= piece):
                    out.append(row(tuple(held), ids, no))
                    ids, no = [], no + 1
                held = node
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=[*NODE, "no", "first", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row(tuple(held), ids, no)], names=[*NODE, "no", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        make = lambda out: pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=[*NODE, "ends_sha256"])
        for b in batches:
            out = []
            for *node, ids in zip(*(b.column(x).to_pylist() for x in (*NODE, "ids")), strict=True):
                if node != held:
                    if held:
                        out.append((*held, state.hexdigest()))
                    held, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield make(out)
        if held:
            yield make([(*held, state.hexdigest())])

    fields = "depth long, p1 long, p2 long"
    parts = ends.repartitionByRange(*NODE, "c").sortWithinPartitions(*NODE, "c").mapInArrow(joined, f"{fields}, no long, first long, ids string")
    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "first", "no").select(*NODE, "ids").mapInArrow(hashed, f"{fields}, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each distinct beginning of the conversations turns(c, depth, a1, a2, bytes), as rebuilt() gives them; convs(c): all of them, without turns too.

    Columns: conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and position
    and subtree_end: a node's place in the preorder and that of the last node below it.

    Nodes with the same least member form a section, and sections in order of their keys are the preorder (see _sections());
    equal conversations are one there, and a conversation of any length is one row. Places, leaves and savings are prefix sums over the
    preorder; a subtree has what was added up at its last node less what was before its first. The last node is the furthest
    end of a member. All of it is joins, aggregates that combine before the shuffle and prefix_sums(); a common beginning, conversation or id is spread over tasks.

    Conversations without an id take no part. Turns go by number, nulls first, then by their digest; null role and text are
    empty; repeated rows are turns of their own; texts of any length meet as digests; a conversation left without turns is a member of the root alone;
    other columns don't matter; an empty table gives an empty result."""
    members = _members(turns, convs)
    nodes = staged(members.groupBy(*NODE).agg(F.min("c").alias("rep"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("q1").alias("q1"), F.max("q2").alias("q2")))
    sections = _sections(nodes)
    sections = staged(prefix_sums(sections, [], ["key"], {"upto": F.col("bottom") - F.col("top") + 1}))
    kids = sections.where("up is not null").groupBy((F.col("top") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("kids"))
    place = sections.select("rep", "top", "bottom", "up", "upto")
    nodes = nodes.join(place, "rep").join(kids, NODE, "left")
    nodes = nodes.select(*NODE, "rep", "n_convs", F.when(F.col("depth") > F.col("top"), F.col("rep")).otherwise(F.col("up")).alias("parent"), (F.coalesce("kids", F.lit(0)) + (F.col("depth") < F.col("bottom")).cast("long")).alias("n_children"), (F.col("upto") - 1 - F.col("bottom") + F.col("depth")).alias("position"), "bytes")
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    nodes = staged(prefix_sums(nodes, [], ["position"], {"leaves_upto": F.col("leaf"), "saved_upto": F.col("saved")}))

    ends = staged(members.groupBy("c").agg(F.max(F.struct(*NODE)).alias("x")).select("c", "x.*"))
    one = ends.groupBy(*NODE).agg(F.min("c").alias("c"))
    one = staged(one.join(nodes.select(*NODE, "position", "leaves_upto", "saved_upto"), NODE).select("c", F.struct("position", "leaves_upto", "saved_upto").alias("end")))
    below = members.select("c", *NODE).join(one, "c").groupBy(*NODE).agg(F.max("end").alias("end"))
    out = nodes.join(below, NODE).join(_end_hashes(ends), NODE, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("end.leaves_upto") - F.col("leaves_upto") + F.col("leaf")).alias("n_leaves"), (F.col("end.saved_upto") - F.col("saved_upto") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "position", F.col("end.position").alias("subtree_end"),
    )

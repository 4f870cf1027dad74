"""Packing tokenised documents into sequences of fixed length by large-item matching and best fit."""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_type, small_batches, staged

PIECES = "piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit numbers; emptied when it has most words.

    The tokenizer drops white space and joins nothing across it, so words are encoded apart. Of a
    word in plain Latin letters, digits and signs, the normaliser leaves lower case and the
    pre-tokenizer makes the parts below; those go straight to the BPE model. Any other word goes
    through the whole tokenizer, and so does a text that may hold special tokens."""

    PLAIN = re.compile("[!-~\u00c0-\u012f]+")

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most, self.parts = Tokenizer.from_file(path), most, {}
        self.model, self.bytes = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # The split pattern of the public tokenizer file, its letters and digits spelled out for PLAIN.
        self.split = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+|[0-9]|[^a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+").findall

    def part(self, part: str) -> bytes:
        mapped = part if part.isascii() else self.bytes.pre_tokenize_str(part)[0][0]
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])
        if len(self.parts) >= self.most:
            self.parts.clear()
        self.parts[part] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        if len(word) > 100 or not self.PLAIN.fullmatch(word):
            return self.whole(word)
        get = self.parts.get
        ids = b"".join([get(x) or self.part(x) for x in self.split(word.lower())])
        if len(self) >= self.most:
            self.clear()
        self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if text else b""

    def of(self, text: str) -> bytes:
        return self.whole(text) if "<|" in text else b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for each worker process, kept from task to task."""
    return WordIds(path)


def _pieces(path: str, capacity: int, end_id: int, schema: pa.Schema):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path)
        for b in batches:
            out: dict[str, list] = {k: [] for k in schema.names}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = ids.of(text or "") + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    piece = data[at : at + 4 * capacity]
                    for name, x in zip(schema.names, (doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                        out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Packs counts (length -> how many) and returns runs and the number of bins.

    A run (length, first, n, bin, per_bin, offset) says that the items first .. first + n - 1 of
    that length go to the bins from bin on, per_bin to each, from offset on. Items over a third of
    the capacity: the longest meets the longest such item that still fits beside it, so a bin has
    two of them at most. The others, longest first, go where they fit best. All is done for whole
    counts at once, so the work and the result depend on the capacity, not on the number of items."""
    left, used, runs, bins = dict(counts), defaultdict(int), [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first bin, bins)

    def put(length: int, n: int, at: int, per_bin: int, offset: int) -> None:
        runs.append((length, used[length], n, at, per_bin, offset))
        used[length] += n
        left[length] -= n

    large = sorted(x for x in counts if 3 * x > capacity and counts[x])
    for x in reversed(large):
        while left[x]:
            k = bisect.bisect_right(large, min(x, capacity - x)) - 1
            while k >= 0 and left[large[k]] < (2 if large[k] == x else 1):
                k -= 1
            y = large[k] if k >= 0 else 0
            n = left[x] if not y else left[x] // 2 if y == x else min(left[x], left[y])
            put(x, n, bins, 1, 0)
            if y:
                put(y, n, bins, 1, x)
            gaps[capacity - x - y].append((bins, n))
            bins += n
    for x in sorted((x for x in counts if 3 * x <= capacity and counts[x]), reverse=True):
        while left[x]:
            room = min((g for g in gaps if g >= x and gaps[g]), default=0)
            if not room:
                per = capacity // x
                room, n = capacity, -(-left[x] // per)
                gaps[room].append((bins, n))
                bins += n
            at, n = gaps[room].pop()
            per = room // x
            whole = min(n, left[x] // per)
            if whole:
                put(x, whole * per, at, per, capacity - room)
                gaps[room - per * x].append((at, whole))
            elif left[x]:
                whole, rest = 1, left[x]
                put(x, rest, at, rest, capacity - room)
                gaps[room - rest * x].append((at, 1))
            if n > whole:
                gaps[room].append((at + whole, n - whole))
    return runs, bins


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, block_rows: int = 1000) -> DataFrame:
    """One row per piece of a document: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id; only longer ones are cut, into pieces of capacity ids. Full
    pieces and the rest are packed by plan_bins() from the counts of each length (at most capacity
    rows, which is all the driver sees). Items of a length are numbered in blocks of about
    block_rows by a hash of the id, so that a length that many rows share is many tasks.

    Null text counts as empty (one id); texts of any length are read whole. Items of one length are placed in the order of their block, id, piece and ids' crc32; ties of all of these are alike. Repeated rows and null ids are packed like others, each
    row for itself; other columns don't matter; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[0].dataType
    names = ["__id", "piece", "start", "length", "ids_crc32"]
    arrow = pa.schema(list(zip(names, (arrow_type(rows, id_col), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)))
    pieces = staged(rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id, arrow), f"__id {kind.simpleString()}, {PIECES}"))

    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs, _ = plan_bins(counts, capacity)
    by_length: dict[int, list] = defaultdict(list)
    for length, *run in runs:
        by_length[length].append(run)
    table = {k: np.array(v, "i8") for k, v in by_length.items()}  # runs come with rising first item

    blocks = pieces.sparkSession.createDataFrame([(k, -(-n // block_rows)) for k, n in counts.items()] or [(0, 1)], "length long, blocks long")
    pieces = pieces.join(F.broadcast(blocks), "length").withColumn("block", F.pmod(F.xxhash64("__id", "piece", "ids_crc32"), F.col("blocks"))).drop("blocks")
    sums = pieces.groupBy("length", "block").count()
    before = sums.select("length", "block", (F.sum("count").over(Window.partitionBy("length").orderBy("block")) - F.col("count")).alias("before"))
    order = Window.partitionBy("length", "block").orderBy("__id", "piece", "ids_crc32")
    pieces = pieces.join(before, ["length", "block"]).withColumn("rank", F.row_number().over(order) - 1 + F.col("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, k = length.to_numpy("i8"), rank.to_numpy("i8")
        bins, offsets = np.zeros(len(n), "i8"), np.zeros(len(n), "i8")
        for x in np.unique(n):
            here, own = np.flatnonzero(n == x), table[int(x)]
            run = own[np.searchsorted(own[:, 0], k[here], side="right") - 1]
            i = k[here] - run[:, 0]
            bins[here], offsets[here] = run[:, 2] + i // run[:, 3], run[:, 4] + i % run[:, 3] * x
        return pd.DataFrame({"sequence_id": bins, "offset": offsets})

    pieces = pieces.withColumn("__at", place("length", "rank"))
    return pieces.select(F.col("__id").alias(id_col), "piece", "start", "length", "ids_crc32", "__at.sequence_id", "__at.offset")

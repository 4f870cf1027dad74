"""Token counts that follow edits: a segment tree over each document's pre-tokens."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


class Counter(dict):
    """pre-token -> number of its tokens; emptied when it has most."""

    def __init__(self, path: str, pattern: str, most: int = 1_000_000) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split, self.most = regex.compile(pattern).findall, most

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding._encode_single_piece(piece))
        if len(self) >= self.most:
            self.clear()
        if len(piece) <= 64:
            self[piece] = n
        return n


@functools.cache
def counter(path: str, pattern: str) -> Counter:
    """One for each worker process."""
    return Counter(path, pattern)


class TokenTree:
    """Sums of characters and tokens over the pre-tokens of a text, kept as the text is edited.

    A leaf is a pre-token, or after an edit a few of them. Splitting goes from
    left to right, and where a pre-token ends depends on the white space and the one character
    behind it. So an edit is encoded anew from two leaves (and any of white space) before it to
    the first later place where a new boundary falls on an old one; the rest stays as it is. The new
    pre-tokens go to the leaves of the old ones; where a leaf would get more than CROWD, the tree is laid out anew, without encoding."""

    CROWD = 8

    def __init__(self, text: str, counts: Counter) -> None:
        self.counts, self.encoded = counts, 0
        pieces = counts.split(text)
        self._lay(text, pieces, np.fromiter(map(counts.__getitem__, pieces), np.int64, len(pieces)))

    def _lay(self, text: str, pieces: list[str], tokens: np.ndarray) -> None:
        self.text, self.n = text, len(pieces)
        self.size = 1 << max(0, (self.n - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + self.n, 0] = np.fromiter(map(len, pieces), np.int64, self.n)
        self.sums[self.size : self.size + self.n, 1] = tokens
        width = self.size
        while width > 1:
            self.sums[width // 2 : width] = self.sums[width : 2 * width : 2] + self.sums[width + 1 : 2 * width : 2]
            width //= 2
        self.start = np.concatenate([[0], np.cumsum(self.sums[self.size : self.size + self.n, 0])])
        self.anew: dict[int, list[str]] = {}

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    def leaf_text(self, i: int) -> str:
        return "".join(self.anew[i]) if i in self.anew else self.text[self.start[i] : self.start[i + 1]]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at, and where the leaf starts."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if at - before >= self.sums[k, 0]:
                before += int(self.sums[k, 0])
                k += 1
        return k - self.size, before

    def put(self, i: int, pieces: list[str]) -> None:
        self.anew[i] = pieces
        k = i + self.size
        change = np.array([sum(map(len, pieces)), sum(map(self.counts.__getitem__, pieces))]) - self.sums[k]
        while k and change.any():
            self.sums[k] += change
            k //= 2

    def lay_anew(self) -> None:
        pieces: list[str] = []
        for i in range(self.n):
            pieces += self.anew[i] if i in self.anew else [self.text[self.start[i] : self.start[i + 1]]]
        self._lay("".join(pieces), pieces, np.fromiter(map(self.counts.__getitem__, pieces), np.int64, len(pieces)))

    def edit(self, at: int, delete: int, insert: str) -> None:
        """Replaces delete characters from at on; both are cut to the text as it is."""
        at = min(max(at, 0), self.chars)
        delete = min(max(delete, 0), self.chars - at)
        if not self.n:
            encoded = self.encoded + len(insert)
            self.__init__(insert, self.counts)
            self.encoded = encoded
            return
        first, start = self.find(at) if at < self.chars else (self.n, self.chars)
        back = 0
        while first > 0 and (back < 2 or self.leaf_text(first).isspace() or not self.leaf_text(first)):
            first -= 1
            start -= len(part := self.leaf_text(first))
            back += bool(part)
        stop, old, ends, more = first, [], [], 8
        have = 0
        while True:
            while stop < self.n and (have < at + delete - start or more > 0):
                part = self.leaf_text(stop)
                stop += 1
                if not part:
                    continue
                more -= have >= at + delete - start and not part.isspace()
                have += len(part)
                old.append(part)
                ends.append((have, stop))
            text = "".join(old)
            text = text[: at - start] + insert + text[at - start + delete :]
            pieces = self.counts.split(text)
            shift, new_end = len(insert) - delete, at - start + len(insert)
            known, place, found = dict(ends), 0, None
            trusted = len(pieces) if stop >= self.n else len(pieces) - 4
            for k, piece in enumerate(pieces):
                if k >= trusted:
                    break
                place += len(piece)
                if place >= new_end and place - shift in known and (stop >= self.n or any(not x.isspace() for x in pieces[k + 1 :])):
                    found = known[place - shift]
                    break
            if found is not None or stop >= self.n:
                break
            more = 2 * len(pieces)
        self.encoded += len(text)
        if found is None:  # to the end of the text
            found, k = self.n, len(pieces) - 1
        first, pieces = min(first, self.n - 1), pieces[: k + 1] if pieces else []
        each = -(-len(pieces) // (found - first)) or 1
        for j, i in enumerate(range(first, found)):
            self.put(i, pieces[j * each : (j + 1) * each])
        if each > self.CROWD:
            self.lay_anew()


def count_with_edits(docs: DataFrame, tokenizer_path: str, pattern: str, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, tokens, tokens_after, chars_after, n_edits and chars_encoded.

    edits_col: array<struct<at:int,delete:int,insert:string>>, applied in order, each to the text
    as the ones before left it; places and sizes beyond the text are cut to it. tokens are those of
    the whole text, tokens_after those after the edits; chars_encoded is what the edits had encoded
    anew. Null text counts as empty, null edits as none; null parts of an edit as 0 or "". Repeated
    rows and null ids are counted each for itself; other columns don't matter; texts of any length are
    counted whole, a document and its tree in one task's memory; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"), F.col(edits_col).alias("__edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer_path, pattern)
        for b in batches:
            out = []
            for text, edits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                tree = TokenTree(text or "", counts)
                before = tree.tokens
                for e in edits or []:
                    if e:
                        tree.edit(e["at"] or 0, e["delete"] or 0, e["insert"] or "")
                out.append((before, tree.tokens, tree.chars, len(edits or []), tree.encoded))
            columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[id_col, "tokens", "tokens_after", "chars_after", "n_edits", "chars_encoded"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, tokens long, tokens_after long, chars_after long, n_edits long, chars_encoded long")

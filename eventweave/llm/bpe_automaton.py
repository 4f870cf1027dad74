"""Byte-pair encoding by an automaton over tokens, and decoding by its arc labels."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .words import mix, powers

START = 0
LETTER, NUMBER, SPACE, OTHER = range(4)
#: Endings that are words of their own after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def letter_classes() -> bytes:
    """Class of every code point as the library's byte-level pre-tokenizer sees it, compressed; asked of the library, as Unicode versions differ.

    Planes without assigned characters are OTHER."""
    import zlib

    from tokenizers.pre_tokenizers import ByteLevel

    cut, out = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str, np.full(0x110000, OTHER, np.uint8)
    for low in [*range(0, 0x40000, 4096), 0xE0000]:
        codes = [c for c in range(low, low + 4096) if not 0xD800 <= c < 0xE000]
        if codes:
            starts = np.zeros(7 * len(codes) + 1, bool)
            starts[[at for _, (at, _) in cut("".join(f"a{chr(c)}1 {chr(c)}x\n" for c in codes))]] = True
            starts = starts[:-1].reshape(-1, 7)
            out[codes] = np.where(starts[:, 4], SPACE, np.where(~starts[:, 1], LETTER, np.where(~starts[:, 2], NUMBER, OTHER)))
    return zlib.compress(out.tobytes())


def word_starts(code: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words start in joined texts: code points, their classes, and which are the first of a text.

    A word is a run of one class with one space before it; of white space before a word the last character
    stays out of the run, and after a lone apostrophe an ending is a word with it."""
    n = len(code)
    new = first.copy()
    new[1:] |= kind[1:] != kind[:-1]
    last = np.append(new[1:], True)  # last of its run
    ends_text = np.append(first[1:], True)
    start = new.copy()
    # The last white space before other things starts anew, and a space takes the run after it along.
    before = last & (kind == SPACE) & ~ends_text
    start |= before
    led = np.zeros(n, bool)  # runs with a space in front
    led[1:] = (before & (code == 32))[:-1]
    start &= ~led
    quote = np.flatnonzero((code == 39) & new & last & start & ~ends_text)
    size = np.zeros(len(quote), np.int64)
    for ending in ENDINGS:
        fits = quote + len(ending) < n
        for i, letter in enumerate(ending, 1):
            at = np.minimum(quote + i, n - 1)
            fits &= (code[at] == ord(letter)) & ~first[at]
        size[fits & (size == 0)] = len(ending)
    quote, size = quote[size > 0], size[size > 0]
    start[quote + 1] = False
    rest = quote + 1 + size
    start[rest[rest < n]] = True
    return np.flatnonzero(start)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary(NamedTuple):
    """label: bytes of each token; merges: (left, right, made) in order; whole: tokens that texts hold as they are written, such as marks of an end."""

    label: list[bytes]
    merges: list[tuple[int, int, int]]
    whole: dict[str, int]


def read_vocabulary(path: str) -> Vocabulary:
    """From a tokenizers file of a byte-level BPE; ValueError for what the automaton doesn't do."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, pre, more = whole["model"], whole.get("pre_tokenizer") or {}, whole.get("added_tokens") or []
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or whole.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("a byte-level BPE without normaliser, prefix space or dropout is needed")
    if any(t.get(x) for t in more for x in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that strip, are normalised or need word ends aren't supported")
    letters, ids = byte_letters(), model["vocab"]
    label = [b""] * (1 + max([*ids.values(), *(t["id"] for t in more)]))
    for token, i in ids.items():
        label[i] = bytes(letters[c] for c in token)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    for t in more:
        label[t["id"]] = t["content"].encode()
    return Vocabulary(label, [(ids[a], ids[b], ids[a + b]) for a, b in pairs], {t["content"]: t["id"] for t in more})


class TokenAutomaton:
    """The deterministic automaton whose arcs are tokens and whose paths are exactly the encodings of texts.

    At first there is one state with a loop for each byte. Each merge (a, b) -> c in turn puts in a
    gadget: the state that a leads to is copied without its arc b, a leads to the copy from now on,
    and wherever an arc a leaves, an arc c leaves too, to where b led. So each merge that can occur adds a
    state, and the state that a token leads to is the same from everywhere (`after`).

    50,000 states of up to 50,000 arcs aren't written out: a state keeps what it was copied from, the arc cut and when.
    A state lacks arc c if c was cut on the way of its copies, or if c came after the copy and its left
    part was lacking. Copies of one token's state are looked up together. Arcs asked for are kept in a table."""

    def __init__(self, vocabulary: Vocabulary, most_arcs: int = 300_000) -> None:
        self.label, n, self.most = vocabulary.label, len(vocabulary.label), most_arcs
        self.left, self.right, self.born = [-1] * n, [-1] * n, [-1] * n
        #: States: the token whose state was copied (own), the arc cut, the merge that did it; `base` is the state copied.
        self.base, self.cut, self.made = [START], [-1], [-1]
        self.after: list[int] = [-1] * n
        self.cuts: dict[int, int] = {}  # (token, arc cut from its state) -> merge
        self.arcs: dict[int, bool] = {}
        self.n = n
        made = {c for _, _, c in vocabulary.merges}
        for i, text in enumerate(self.label):
            if len(text) == 1 and i not in made:
                self.after[i] = START
        for time, (a, b, c) in enumerate(vocabulary.merges):
            self._gadget(time, a, b, c)
        self.steps, self.shorter = self._spell(vocabulary)

    def _gadget(self, time: int, a: int, b: int, c: int) -> None:
        if self.after[a] < 0 or self.after[b] < 0 or self.after[c] >= 0 or not self._leaves(a, b):
            return  # the pair never occurs
        copy = len(self.base)
        self.base.append(self.after[a])
        self.cut.append(b)
        self.made.append(time)
        self.after[c], self.left[c], self.right[c], self.born[c] = self.after[b], a, b, time
        self.after[a] = copy
        self.cuts[a * self.n + b] = time

    def _leaves(self, t: int, c: int) -> bool:
        """Whether the state that t leads to has arc c.

        The state's copies are those made for t, before them those for the right part of t up to the
        birth of t, and so on; while a copy is older than c, its left part stands for c."""
        limit = len(self.base) + len(self.cuts) + 1 << 32
        while t >= 0:
            x, newer = c, limit
            while x >= 0:
                time = self.cuts.get(t * self.n + x, -1)
                if 0 <= time < limit and (x == c or time <= newer):
                    return False
                x, newer = self.left[x], self.born[x]
            t, limit = self.right[t], self.born[t]
        return True

    def has_arc(self, last: int, c: int) -> bool:
        """The same from a table; last: the token before, or -1 at the start."""
        key = last * self.n + c
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= self.most:
                self.arcs.clear()
            known = self.arcs[key] = last < 0 or self._leaves(last, c)
        return known

    def _spell(self, vocabulary: Vocabulary) -> tuple[dict, list[int]]:
        """Arcs spelled out byte by byte: a table of byte -> (next table, the token that ends there or -1), and each token's longest beginning that is a token."""
        top, apart = {}, set(vocabulary.whole.values())
        for i, text in enumerate(self.label):
            if self.after[i] >= 0 and i not in apart:
                table = top
                for at, byte in enumerate(text, 1):
                    entry = table.setdefault(byte, ({}, -1))
                    if at == len(text):
                        entry = table[byte] = (entry[0], i)
                    table = entry[0]
        shorter = [-1] * self.n
        for i, text in enumerate(self.label):
            if self.after[i] >= 0 and i not in apart:
                table = top
                for byte in text[:-1]:
                    table, end = table[byte]
                    if end >= 0:
                        shorter[i] = end
        return top, shorter

    def encode(self, word: bytes) -> list[int]:
        """The tokens of the one path that spells word.

        From each place, table steps spell the longest arc; the path goes on by the longest that leaves its state, and steps back
        to a shorter one where none does. Every beginning of word has one path only, so a place left once is never come to again, and
        the work is linear in the word's length."""
        n, steps, shorter, arcs, size, label = len(word), self.steps, self.shorter, self.arcs, self.n, self.label
        path, at, last, left = [], 0, -1, set()
        while at < n:
            c, table = -1, steps
            for j in range(at, n):
                entry = table.get(word[j])
                if entry is None:
                    break
                table, end = entry
                if end >= 0:
                    c = end
            while True:
                while c >= 0:
                    to = at + len(label[c])
                    if to not in left:
                        known = arcs.get(last * size + c)
                        if known or (known is None and self.has_arc(last, c)):
                            break
                    c = shorter[c]
                if c >= 0:
                    break
                if not path:
                    raise ValueError(f"{word!r} can't be spelled with the tokens")
                left.add(at)
                c = path.pop()
                at -= len(label[c])
                last, c = path[-1] if path else -1, shorter[c]
            path.append(c)
            at, last = to, c
        return path


class Encoder(dict):
    """Word -> its tokens as little-endian 32-bit numbers; emptied when it holds most."""

    def __init__(self, path: str, classes: bytes, most: int = 150_000) -> None:
        import re
        import zlib

        vocabulary = read_vocabulary(path)
        self.automaton, self.most, self.whole = TokenAutomaton(vocabulary), most, vocabulary.whole
        self.classes = np.frombuffer(zlib.decompress(classes), np.uint8)
        names = sorted(self.whole, key=lambda x: (-len(x), x))
        self.marks = re.compile(f"({'|'.join(map(re.escape, names))})").split if names else None

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.automaton.encode(word.encode()), "<i4").tobytes()
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids

    def words_of(self, texts: list[str], chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of texts without names of added tokens in a row, and where each text's begin and end; in chunks, as the arrays on the way take some 80 bytes a letter."""
        tokens, ends, part, size = [np.zeros(0, "<i4")], [np.zeros(1, np.int64)], [], 0
        for i, text in enumerate(texts, 1):
            part.append(text)
            size += len(text)
            if size >= chunk or i == len(texts):
                found, upto = self._words_of(part)
                tokens.append(found)
                ends.append(upto[1:] + ends[-1][-1])
                part, size = [], 0
        return np.concatenate(tokens), np.concatenate(ends)

    def _words_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.concatenate([[0], np.cumsum(sizes)])
        if not joined:
            return np.zeros(0, "<i4"), np.zeros(len(at), np.int64)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.zeros(len(code) + 1, bool)
        first[at] = True
        start = word_starts(code, self.classes[code], first[:-1])
        end = np.append(start[1:], len(code))
        # Equal words are looked up once. Hashes find them; words that aren't the same letter by letter are looked up by themselves.
        _, some, which = np.unique(word_hashes(code, start, end), return_index=True, return_inverse=True)
        length = end - start
        like = length == length[some][which]
        spot = np.flatnonzero(np.repeat(like, length))
        offset = np.repeat(start[some][which] - start, length)[spot]
        differs = spot[code[spot] != code[spot + offset]]
        like[np.searchsorted(start, differs, "right") - 1] = False
        odd = np.flatnonzero(~like)
        if len(odd):
            which[odd] = len(some) + np.arange(len(odd))
            some = np.concatenate([some, odd])
        found = [self[joined[a:b]] for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)]
        ids, n = np.frombuffer(b"".join(found), "<i4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(n) - n
        many = n[which]
        upto = np.concatenate([[0], np.cumsum(many)])
        tokens = ids[np.repeat(begins[which] - upto[:-1], many) + np.arange(upto[-1])]
        return tokens, upto[np.searchsorted(start, at)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in a row, and where each text's begin and end."""
        if not self.marks or not any(name in t for t in texts for name in self.whole):
            return self.words_of(texts)
        parts = [self.marks(t) for t in texts]
        tokens, ends = self.words_of([p for x in parts for p in x[::2]])
        out, upto, k = [np.zeros(0, "<i4")], [0], 0
        for x in parts:
            for i, part in enumerate(x):
                if i % 2:
                    out.append(np.array([self.whole[part]], "<i4"))
                else:
                    out.append(tokens[ends[k] : ends[k + 1]])
                    k += 1
                if i + 1 == len(x):
                    upto.append(sum(map(len, out[-len(x) :])) + upto[-1])
        return np.concatenate(out), np.array(upto)


def word_hashes(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of code points."""
    up, down = powers(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


@functools.cache
def encoder(path: str, classes: bytes) -> Encoder:
    """One for each worker process."""
    return Encoder(path, classes)


@functools.cache
def arc_labels(path: str) -> list[bytes]:
    return read_vocabulary(path).label


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids_col array<int>): the tokens of each row's whole text, as the tokenizers library gives them for the file at path, without special tokens put around.

    Words are cut as the file's ByteLevel pre-tokenizer does, and each distinct word of a batch takes at most one walk
    through the automaton. The names of added tokens in a text become those tokens.
    Null text counts as empty and has no tokens; repeated rows and null ids are encoded each for itself;
    texts and words of any length are encoded whole, in memory proportional to the longest text;
    other columns don't matter; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession, 4)
    rows, classes = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")), letter_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, classes).encode
        for b in batches:
            tokens, ends = encode([t or "" for t in b.column(1).to_pylist()])
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, ids_col])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, `{ids_col}` array<int>")


def bpe_decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """(id_col, ids_col, text_col): the text that the arcs' labels spell, special tokens as they are written.

    Bytes that aren't UTF-8 become U+FFFD, as in the tokenizers library; null parts and numbers outside the
    vocabulary are passed over; null ids_col gives empty text. Every row is decoded for itself; other columns don't matter;
    an empty table gives an empty result."""
    small_batches(rows.sparkSession, 4)
    rows = rows.select(F.col(id_col), F.col(ids_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = arc_labels(path)
        n = len(label)
        for b in batches:
            texts = []
            for ids in b.column(1):
                ids = ids.as_py() if ids.values is None or ids.values.null_count else ids.values.to_numpy().tolist()
                texts.append(b"".join([label[i] for i in ids or [] if i is not None and 0 <= i < n]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=[id_col, ids_col, text_col])

    kinds = [f.dataType.simpleString() for f in rows.schema]
    return rows.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{ids_col}` {kinds[1]}, `{text_col}` string")

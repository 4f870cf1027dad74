"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .words import CLASSES, LOWER, UPPER, Words, scan

EDGES, TRAILING = ",.;:!?\"'#$%&*", ",.;:!?\"'"
KINDS = ("email", "ip", "card", "phone")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may stand before a value in the same word: "tel:", "mailto:", "IP=".
LABEL = re.compile(r"^[A-Za-z_-]+[:=]+")
LOCAL, HOST = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

# The small labelled table. {e} e-mail, {i} address, {c} card, {p} phone, {q} phone that only a word before it tells, {g} phone in groups, {n} other numbers; all else is O.
TEMPLATES = (
    "please write to {e} or call {p} today", "mail: {e}, phone: {p}.", "the server {i} is down", "from {i} to {i} in 25 days", "card {c} expires 12/27",
    "paid with {c} on 2024-01-05", "the price is 1,250.00 or 3.5 % of 1999", "in 1984 there were 120 of them, and 37 left", "see chapter 3.2 and page 417", "version 2.10.4 came in May",
    "no names here, only plain words and more of them", "{e}", "{p} {p}", "call {p}", "IP={i}", "order 4471 of 12 items at 9:30", "THE WORDS!! ARE LOUD!! AND LONG!!", "a### b$$$ c%%% d&&&", "at home, at work", "id 8831-A, room 12b, 1st floor", "words around {c} and words", "und der {e} ist da", "que la {p} de los", "dans le {i} et la", "sum 123456789 of 98765",
    "call {q}", "phone {q} ok", "Tel. {q}", "please ring {q} after six", "mobile: {q}, home", "fax {q}", "my phone is {q}", "the {g} line is open", "or {g}", "{g}", "reach me on {g} at home", "call {g}",
    "number {n} of the list", "id {n}", "{n}", "order {n} was paid", "at {n} in the log", "call me in {n} days", "phone number and {n} more", "account {n} is closed", "{n} {n}", "sum of 120 555 and 1984", "in 2019 2020 2021", "rows 100 200 3000 of it",
    "tel:{p}", "mailto:{e}", "phone={p} or IP={i}", "order 4471-2281-9034 of 2024", "part 555-010 and 12-34-56", "build 10.2.33 and 1.2.3.4.5", "ref: 2024-11-05/0093",
)
VALUES = {
    "email": ("ann.lee@mail.example.com", "bob_7@example.org", "c.d+tag@sub.example.net", "info@example.co", "x@y.example"),
    "ip": ("10.0.0.1", "192.168.12.254", "8.8.4.4", "172.16.0.33", "203.0.113.77"),
    "card": ("4111111111111111", "5500000000000004", "4716 3300 1122 0099", "4485-2759-5174-8871", "340000000000009"),
    "phone": ("+1 (555) 010-0199", "+44 20 7946 0958", "+1-202-555-0143", "(202) 555-0171", "555-010-4477"),
    "local": ("2125550134", "040 7654321", "0151-9876543", "5550104477", "089 1234567"),
    "grouped": ("212 555 0134", "415 555 2671", "555 010 4477", "303 555 0122", "646 555 0190"),
    "number": ("1699999999", "20240105", "0098-7654321", "123-45-6789", "978-0-306-40615-7"),
}
#: Words before which a number is likely to be a phone's.
CUES = ("phone", "telephone", "tel", "call", "ring", "mobile", "cell", "fax", "dial", "whatsapp")


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping per kind, in time linear in the text.

    An e-mail's local part is grown to the left of each @; an address starts where a run of
    digits does. Both find what the plain patterns find, without their rescans."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := HOST.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if any(d in text for d in "0123456789"):
        out += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = re.sub(r"[\x20-]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(word: str) -> str:
    """Cue for the CUES, else letters to a, digits to 0 (runs of digits with their length up to 5, the rest marked by +), signs kept, runs of letters and signs cut to one."""
    if word in cue_words():
        return "cue"
    word = word.rstrip(TRAILING)
    if word.isalpha():
        return "a"
    word = re.sub(r"[^\W\d_]+", "a", word)
    word = re.sub(r"\d+", lambda m: "0" * min(len(m[0]), 5) + "+" * (len(m[0]) > 11), word)
    return re.sub(r"([^\w+])\1+", r"\1", word)


@functools.cache
def cue_words() -> frozenset[str]:
    """The cues as they are written, with a sign behind or none."""
    return frozenset(c + sign for cue in CUES for c in (cue, cue.title(), cue.upper()) for sign in ("", ".", ":", ".:"))


def features(s: str) -> list[str]:
    return ["bias", f"s={s}", f"at={'@' in s and '.' in s.partition('@')[2]}", f"digits={min(s.count('0'), 12)}", f"dots={min(s.count('.'), 4)}", f"plain={s == 'a'}", f"cue={s == 'cue'}", f"head={s[:1]}", f"long={'+' in s[1:]}", f"paren={s.startswith('(')}", f"signs={bool(re.search(r'[#$%&*!=/]', s))}"]


class Crf:
    """Linear-chain CRF: labels O and KINDS; a word's emission sums the weights of its own features and of those of the words beside it."""

    LABELS = ("O", *KINDS)

    def __init__(self) -> None:
        k = len(self.LABELS)
        self.names: dict[str, int] = {}
        self.w, self.trans = np.zeros((0, 3, k)), np.zeros((k, k))

    def emission(self, s: str) -> np.ndarray:
        """(3, labels): what a word of shape s adds for the word after it, itself and the word before it."""
        return self.w[[self.names[f] for f in features(s) if f in self.names]].sum(axis=0)

    def fit(self, rows: list[tuple[list[str], list[int]]], steps: int = 150, rate: float = 0.5, l2: float = 2e-3) -> Crf:
        """Gradient ascent (Adagrad) on the conditional log-likelihood, by forward-backward over all rows at once."""
        shapes = sorted({s for x, _ in rows for s in x})
        for s in shapes:
            for f in features(s):
                self.names.setdefault(f, len(self.names))
        has = np.zeros((len(shapes) + 1, len(self.names)))  # the last shape: beyond a row's ends
        for i, s in enumerate(shapes):
            has[i, [self.names[f] for f in features(s)]] = 1
        n, k = max(len(x) for x, _ in rows), len(self.LABELS)
        grid, y = np.full((n + 2, len(rows)), len(shapes)), np.zeros((n, len(rows)), int)
        for r, (x, labels) in enumerate(rows):
            grid[1 : len(x) + 1, r], y[: len(x), r] = [shapes.index(s) for s in x], labels
        live, gold = grid[1:-1] < len(shapes), np.eye(k)[y]
        self.w = np.zeros((len(self.names), 3, k))
        seen_w, seen_t = np.full(self.w.shape, 1e-2), np.full((k, k), 1e-2)
        for _ in range(steps):
            e = np.einsum("sf,fdk->sdk", has, self.w)
            e = (e[grid[:-2], 0] + e[grid[1:-1], 1] + e[grid[2:], 2]) * live[:, :, None]
            one, two = self.chances(e, live)
            d = np.where(live[:, :, None], gold - one, 0)
            gw = -l2 * self.w
            for side in range(3):
                by_shape = np.zeros((len(shapes) + 1, k))
                np.add.at(by_shape, grid[side : side + n], d)
                gw[:, side] += has.T @ by_shape
            gt = -l2 * self.trans + np.where(live[1:, :, None, None], gold[:-1, :, :, None] * gold[1:, :, None, :] - two, 0).sum(axis=(0, 1))
            seen_w += gw * gw
            seen_t += gt * gt
            self.w += rate * gw / np.sqrt(seen_w)
            self.trans += rate * gt / np.sqrt(seen_t)
        return self

    def chances(self, e: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances of each label and of each pair of labels in a row, by forward-backward: e (steps, rows, labels), live (steps, rows)."""
        n, a, b = len(e), e.copy(), np.zeros_like(e)
        for t in range(1, n):
            a[t] = np.where(live[t, :, None], e[t] + np.logaddexp.reduce(a[t - 1][:, :, None] + self.trans, axis=1), a[t - 1])
        for t in range(n - 2, -1, -1):
            b[t] = np.where(live[t + 1, :, None], np.logaddexp.reduce(self.trans + (e[t + 1] + b[t + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(a[-1], axis=1)
        pairs = a[:-1, :, :, None] + self.trans + (e[1:] + b[1:])[:, :, None, :] - z[:, None, None]
        return np.exp(a + b - z[:, None]), np.exp(np.minimum(pairs, 0))

    def viterbi(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels for a batch: emissions (steps, rows, labels), rows by falling length; padding stays O."""
        steps, rows, k = emissions.shape
        back = np.zeros((steps, rows, k), np.int8)
        best, path = emissions[0].copy(), np.zeros((steps, rows), np.int8)
        live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # rows longer than the step
        for t in range(1, steps):
            n = live[t]
            s = best[:n, :, None] + self.trans
            back[t, :n] = s.argmax(axis=1)
            best[:n] = s.max(axis=1) + emissions[t, :n]
        last = best.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            n = live[t]
            path[t, :n] = last[:n]
            last[:n] = back[t, np.arange(n), last[:n]]
        return path


def labelled_table() -> list[tuple[list[str], list[int]]]:
    """The training rows: every template with each turn of values, as shapes and labels."""
    rows, marks = [], {"{e}": "email", "{i}": "ip", "{c}": "card", "{p}": "phone", "{q}": "local", "{g}": "grouped", "{n}": "number"}
    label = {"local": "phone", "grouped": "phone", "number": "O"}
    for template in TEMPLATES:
        for turn in range(5):
            x, y = [], []
            for word in template.split():
                mark = next((m for m in marks if m in word), None)
                value = word.replace(mark, VALUES[marks[mark]][turn]) if mark else word
                for part in value.split():
                    x.append(shape(part))
                    y.append(Crf.LABELS.index(label.get(marks[mark], marks[mark])) if mark else 0)
            rows.append((x, y))
    return rows


class Shapes(dict):
    """word -> number of its shape (0: letters only); emissions holds what a word of each shape adds."""

    def __init__(self, crf: Crf) -> None:
        self.crf, self.of_shape, self.emissions = crf, {"a": 0}, np.zeros((16, 3, len(Crf.LABELS)))
        self.emissions[0] = crf.emission("a")
        self.plain: dict[int, np.ndarray] = {}

    def __missing__(self, word: str) -> int:
        s = shape(word)
        known = tuple(self.crf.names.get(f) for f in features(s)) if s != "a" else "a"  # all that counts of a shape, however long
        if known not in self.of_shape:
            k = self.of_shape[known] = len(self.of_shape)
            if k >= len(self.emissions):
                self.emissions = np.concatenate([self.emissions, np.zeros_like(self.emissions)])
            self.emissions[k] = self.crf.emission(s)
        if len(self) >= 500_000:
            self.clear()
        n = self.of_shape[known]
        if len(word) <= 256:
            self[word] = n
        return n

    def decode(self, grid: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Labels (steps, rows) of the shapes in grid (steps, rows), rows by falling length."""
        e = self.emissions[grid, 1]
        e[1:] += self.emissions[grid[:-1], 0]
        e[:-1] += np.where((np.arange(1, len(grid))[:, None] < lengths)[:, :, None], self.emissions[grid[1:], 2], 0)
        return self.crf.viterbi(e, lengths)

    def decode_plain(self, n: int) -> np.ndarray:
        """Labels of a line of n words of letters: they depend on n alone."""
        if n not in self.plain:
            self.plain[n] = self.decode(np.zeros((n, 1), np.int32), np.array([n]))[:, 0]
        return self.plain[n]


@functools.cache
def model() -> Shapes:
    """Trained once in each worker process, from the labelled table; there is no chance in it."""
    return Shapes(Crf().fit(labelled_table()))


@functools.cache
def cue_hashes() -> np.ndarray:
    return np.concatenate([w.hashes() for w in scan(sorted(cue_words()))])


def _shape_numbers(words: Words, shapes: Shapes) -> np.ndarray:
    """Shapes of all words of a chunk; words of letters with at most one sign behind are seen to in numpy."""
    letters = (CLASSES[np.minimum(words.code, 0x2FFF)] & (LOWER | UPPER) > 0) & (words.code < 0x3000)
    others = np.concatenate([[0], np.cumsum(~letters)])
    odd = others[words.end] - others[words.start]
    last = np.isin(words.code[words.end - 1], [ord(c) for c in TRAILING]) & (words.end - words.start > 1)
    out, text = np.zeros(len(words.start), np.int32), "\n".join(words.texts)
    cue = np.isin(words.hashes(), cue_hashes()) if len(words.start) else np.zeros(0, bool)
    for i in np.flatnonzero((odd > last) | cue):
        out[i] = shapes[text[words.start[i] : words.end[i]]]
    return out


def crf_spans(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans of words that the CRF labels with a kind; a sequence is a line of a text."""
    shapes, out, chunks, queue, base = model(), [], [], [], 0
    for words in scan(texts):
        numbers = _shape_numbers(words, shapes)
        ends = np.searchsorted(words.start, np.append(np.flatnonzero(words.code == 10), len(words.code)))
        firsts = np.concatenate([[0], ends[:-1]])
        odd = np.concatenate([[0], np.cumsum(numbers > 0)])
        labels = np.zeros(len(numbers), np.int8)
        for a, b in zip(firsts[ends > firsts].tolist(), ends[ends > firsts].tolist(), strict=True):
            if odd[b] > odd[a]:
                queue.append((b - a, base + a))
            elif (plain := shapes.decode_plain(b - a)).any():
                labels[a:b] = plain
        chunks.append((words, ends, labels, numbers))
        base += len(numbers)
    numbers, every = (np.concatenate([c[i] for c in chunks] or [np.zeros(0, np.int32)]) for i in (3, 2))
    queue.sort(reverse=True)
    sizes, places = np.array([n for n, _ in queue], int), np.array([a for _, a in queue], int)
    i = 0
    while i < len(queue):
        steps, rows = int(sizes[i]), slice(i, i + max(1, 200_000 // int(sizes[i])))
        lengths, at = sizes[rows], places[rows]
        held = np.arange(steps)[:, None] < lengths
        place = np.where(held, at + np.arange(steps)[:, None], 0)
        path = shapes.decode(np.where(held, numbers[place], 0), lengths)
        every[place[held]] = path[held]
        i = rows.stop
    base = 0
    for words, ends, labels, _ in chunks:
        labels = every[base : base + len(labels)]
        base += len(labels)
        new: list[list[tuple[int, int, str]]] = [[] for _ in words.texts]
        found, i = np.flatnonzero(labels), 0
        of_text, of_line = np.searchsorted(words.first, found, side="right") - 1, np.searchsorted(ends, found, side="right")
        while i < len(found):
            j, k, kind = i, of_text[i], Crf.LABELS[labels[found[i]]]
            s = int(words.start[found[i]] - words.at[k])
            joined = lambda j: words.texts[k][s : int(words.end[found[j]] - words.at[k])].strip(EDGES)  # noqa: B023, E731
            while kind in ("phone", "card") and j + 1 < len(found) and found[j + 1] == found[j] + 1 and of_line[j + 1] == of_line[j] and labels[found[j + 1]] == labels[found[j]] and sum(map(str.isdigit, joined(j + 1))) <= (15 if kind == "phone" else 19):
                j += 1
            core = LABEL.sub("", joined(j))
            s = words.texts[k].index(core, s)
            new[k].append((s, s + len(core), kind))
            i = j + 1
        out += new
    return out


def plausible(kind: str, found: str) -> bool:
    """An added span must look like its kind: the method widens the patterns, it doesn't guess at plain words."""
    digits = sum(c.isdigit() for c in found)
    if kind == "card" and not luhn(re.sub(r"[^0-9]", "", found)):
        return False
    return {"email": "@" in found[1:-1], "ip": digits >= 4 and found.count(".") == 3, "card": 12 <= digits <= 19, "phone": 9 <= digits <= 15}[kind] and not (kind != "email" and any(c.isalpha() for c in found))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, base and added (arrays of kind, start, end; code points, end exclusive).

    base: the fixed patterns. added: spans of the CRF that overlap no base span. Null text counts
    as empty; repeated rows and null ids are treated like others, each row for itself; other
    columns don't matter; an empty table gives an empty result. The whole text is read, words of any length too. Spans that begin
    together go in the order of KINDS; of an added span, a label before the value ("tel:") is left out, and cards must pass Luhn."""
    spans = "array<struct<kind:string,start:int,end:int>>"
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, base {spans}, added {spans}"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda x: [{"kind": k, "start": s, "end": e} for s, e, k in x]
        for b in batches:
            texts, bases, news = [t or "" for t in b.column(1).to_pylist()], [], []
            for text, found in zip(texts, (x for i in range(0, len(texts), 1000) for x in crf_spans(texts[i : i + 1000])), strict=True):
                base = base_spans(text)
                new = [(s, e, k) for s, e, k in sorted(found) if e > s and plausible(k, text[s:e]) and not any(s < y and x < e for x, y, _ in base)]
                bases.append(as_rows(base))
                news.append(as_rows(new))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bases, arrow), pa.array(news, arrow)], names=[id_col, "base", "added"])

    return rows.mapInArrow(run, schema)

"""Fuzzy passages that documents share: k-mer seeds, collinear chains, alignment."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, if_small, perhaps_in, small_batches, staged, unstaged, without_old_shuffles
from .words import mix, scan

_MUL = np.uint64(0xA0761D6478BD642F)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    h = words.copy()
    for _ in range(k - 1):
        h = mix(h[:-1] * _MUL + words[len(words) - len(h) + 1 :])
    return h


def long_grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by doubling: in log n steps, other values than grams()."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h, step = words, 1
    while step < n:
        on = min(step, n - step)  # the last two halves may overlap
        h = mix(h[:-on] * _MUL + h[on:])
        step += on
    return h


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def seed_places(words: np.ndarray, k: int, sparse: int, window: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of one in `sparse` k-mers, chosen by their hash alone, and of the least of any window of k-mers without such a one.

    So a k-mer that two texts share is a seed of both or of neither, whatever stands around it, and
    any run of k + window - 1 equal words shares a seed. first: where the documents in words begin, and the end of the last; no k-mer reaches from one into the next."""
    first = np.array([0, len(words)]) if first is None else first
    start, end = first[:-1], first[1:] - k + 1  # the places of k-mers
    start, end = start[start < end], end[start < end]
    h = grams(words, k)
    at = np.flatnonzero(h <= np.uint64((1 << 64) // sparse - 1))
    doc = np.searchsorted(start, at, side="right") - 1
    inside = (doc >= 0) & (at < end[doc]) if len(start) else np.zeros(len(at), bool)
    at, doc = at[inside], doc[inside]
    edges = np.sort(np.concatenate([doc << 40 | at + 1, np.arange(len(start)) << 40 | start, np.arange(len(start)) << 40 | end + 1]))
    wide = np.flatnonzero((np.diff(edges) > window) & (edges[1:] >> 40 == edges[:-1] >> 40))
    if len(wide):
        more = [at]
        for i in wide:
            lo, hi = (edges[i : i + 2] & (1 << 40) - 1) - (0, 1)
            view = np.lib.stride_tricks.sliding_window_view(h[lo:hi], window)
            more.append(np.unique(view.argmin(axis=1) + np.arange(lo, lo + len(view))))
        at = np.sort(np.concatenate(more))
    return at, h[at]


#: Bits of a spot: the place, then the distances to the seeds before and behind.
AT, GAP = 31, 6
#: Words on either side of a seed whose 64 bits are its context, and those whose least hash tells who holds the seed in like surroundings.
NEAR, WIDE = 12, 24

#: Holders of a seed that are paired as a list; more are joined.
LISTED = 64


def _windows(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over `width` values (a power of two) from each place on, by doubling."""
    step = 1
    while step < width:
        values = op(values[:-step], values[step:])
        step *= 2
    return values


def _around(values: np.ndarray, at: np.ndarray, k: int, side: int, op: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
    """op over the `side` values before each place, and over those behind it and the k - 1 next; op doesn't mind a value twice."""
    width = 1 << (side.bit_length() - 1)
    over, rest = _windows(values, width, op), side - width
    return op(over[at - side], over[at - width]), op(over[at + k], over[at + k + rest])


def spots_of(words: np.ndarray, at: np.ndarray, k: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spots, contexts, near): three longs for each seed, all that later steps need to know of it and the words around in its document.

    A context has a bit for each of the NEAR words before and behind, wherever among them it stands; near has the least hashes
    of the WIDE words before and of those behind, 32 bits each. first: see seed_places()."""
    first = np.array([0, len(words)]) if first is None else first
    doc = np.searchsorted(first, at, side="right") - 1
    start, end = first[doc], first[doc + 1] - k + 1
    new = np.diff(doc, prepend=-1) > 0
    before = np.where(new, start - 1, np.append(0, at[:-1])[: len(at)])
    behind = np.where(np.append(new[1:], True)[: len(at)], end, np.append(at[1:], 0)[: len(at)])
    spots = at - start | at - before << AT | behind - at << (AT + GAP)
    # WIDE empty places around each document keep its words apart from its neighbours'.
    to = np.arange(len(words)) + np.repeat(np.arange(1, len(first)) * WIDE, np.diff(first))
    bits, least = np.zeros((2, len(words) + len(first) * WIDE), np.uint64)
    least[:] = (1 << 32) - 1
    bits[to], least[to] = np.left_shift(np.uint64(1), words & np.uint64(63)), mix(words) >> np.uint64(32)
    at = at + (doc + 1) * WIDE
    bits, least = _around(bits, at, k, NEAR, np.bitwise_or), _around(least, at, k, WIDE, np.minimum)
    return spots, (bits[0] | bits[1]).view(np.int64), (least[0] << np.uint64(32) | least[1]).view(np.int64)


def place(spot: Column) -> Column:
    return spot.bitwiseAND(F.lit((1 << AT) - 1)).cast("int")


def alike_around(a: Column, b: Column) -> Column:
    """How many bits of two contexts agree: with 12 words on either side some 6 by chance, 10 if one side is alike, 16 and more if both are; inserted and left-out words shift nothing."""
    return F.bit_count(a.bitwiseAND(b))


def joints(doc: np.ndarray, spots: np.ndarray, holder: np.ndarray, to: np.ndarray, k: int, size: int) -> list[tuple[int, int, int]]:
    """(document, first, last place) of the runs of size words with a change of holder or shift between seeds inside, all of whose seeds are held.

    A row for each seed that occurs before: its document, spot, holder, and place there."""
    at, gap = spots & (1 << AT) - 1, (1 << GAP) - 1
    order = np.lexsort((at, doc))
    doc, at, holder, shift, before, behind = doc[order], at[order], holder[order], (to - at)[order], (spots >> AT & gap)[order], (spots >> AT + GAP & gap)[order]
    follows = np.append(False, (doc[1:] == doc[:-1]) & (at[1:] - at[:-1] == before[1:]))
    stretch = np.cumsum(~follows) - 1
    firsts = np.flatnonzero(~follows)
    lasts = np.append(firsts[1:], len(at))[: len(firsts)] - 1
    least, most = at[firsts] - before[firsts] + 1, at[lasts] + behind[lasts] + k - 1 - size
    m = np.flatnonzero(follows & (np.append(False, (holder[1:] != holder[:-1]) | (shift[1:] != shift[:-1]))))
    lo, hi = np.maximum(at[m] + k - size, least[stretch[m]]), np.minimum(at[m - 1], most[stretch[m]])
    out: list[tuple[int, int, int]] = []
    for d, x, y in zip(*(v[lo <= hi].tolist() for v in (doc[m], lo, hi)), strict=True):
        if out and out[-1][0] == d and x <= out[-1][2] + 1:
            out[-1] = (d, out[-1][1], max(y, out[-1][2]))
        else:
            out.append((d, x, y))
    return out


def chain(x: np.ndarray, y: np.ndarray, k: int, gap_cost: float) -> list[np.ndarray]:
    """Parts anchors (x[i], y[i]) into chains that rise in both places, best first; returns their indices.

    Score of an anchor: its own words, plus that of the best anchor before it in both places less
    gap_cost for every word between them on either side. A Fenwick tree over y holds, for a prefix
    of y, the best score plus gap_cost times the places, so an anchor takes two steps of log n."""
    order = np.lexsort((y, x))
    x, y, n = x[order], y[order], len(x)
    if n and (x - y == x[0] - y[0]).all() and (x[1:] > x[:-1]).all():
        return [order[i] for i in _chain_at_one_shift(x.tolist(), y.tolist(), k, gap_cost)]
    ranks = np.unique(y, return_inverse=True)[1] + 1
    top = int(ranks.max()) + 1
    best, arg = [-np.inf] * (top + 1), [-1] * (top + 1)
    score, back = [0.0] * n, [-1] * n
    xs, ys, rs = x.tolist(), y.tolist(), ranks.tolist()
    i = 0
    while i < n:
        j = i
        while j < n and xs[j] == xs[i]:  # anchors at one place of x don't follow each other
            r, found, source = rs[j] - 1, -np.inf, -1
            while r > 0:
                if best[r] > found:
                    found, source = best[r], arg[r]
                r -= r & -r
            own = k
            if source >= 0:
                own = min(k, xs[j] - xs[source], ys[j] - ys[source])
                found = found - gap_cost * (xs[j] + ys[j])
            if source >= 0 and found + own > k:
                score[j], back[j] = found + own, source
            else:
                score[j] = k
            j += 1
        for m in range(i, j):
            r, value = rs[m], score[m] + gap_cost * (xs[m] + ys[m] + 2 * k)
            while r <= top:
                if value > best[r]:
                    best[r], arg[r] = value, m
                r += r & -r
        i = j
    return [order[i] for i in _traced(score, back)]


def _chain_at_one_shift(xs: list[int], ys: list[int], k: int, gap_cost: float) -> list[np.ndarray]:
    """chain() of rising anchors at one shift: the best anchor before one is then always the last, as each adds more than its distance costs."""
    score, back, last = [float(k)], [-1], float(k)
    for m in range(1, len(xs)):
        found = last + gap_cost * (xs[m - 1] + ys[m - 1] + 2 * k) - gap_cost * (xs[m] + ys[m]) + min(k, xs[m] - xs[m - 1])
        linked = found > k
        last = found if linked else float(k)
        score.append(last)
        back.append(m - 1 if linked else -1)
    return _traced(score, back)


def _traced(score: list[float], back: list[int]) -> list[np.ndarray]:
    """Indices of the anchors of each chain, best end first; an anchor goes to the first chain that reaches it."""
    used, out = [False] * len(score), []
    for end in sorted(range(len(score)), key=lambda m: -score[m]):
        part, m = [], end
        while m >= 0 and not used[m]:
            used[m] = True
            part.append(m)
            m = back[m]
        if part:
            out.append(np.array(part[::-1]))
    return out


def extend(a: np.ndarray, b: np.ndarray, drop: int = 10) -> tuple[int, int, bool]:
    """(words, matches, open) by which two runs go on alike from their starts: +1 a match, -2 a mismatch, until drop below the best; open: they might go on beyond the runs."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0, False
    same = a[:n] == b[:n]
    score = np.cumsum(np.where(same, 1, -2))
    fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > drop)
    more = not len(fallen)
    n = n if more else int(fallen[0])
    if not n or score[:n].max() <= 0:
        return 0, 0, more
    n = int(score[:n].argmax()) + 1
    return n, int(same[:n].sum()), more


def longest(core: float, left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
    """(left, right): the most words at both ends of a core that leave matches at least similarity times the words.

    left, right: what so many words more on that side add to the matches less similarity times the words; core: the same of the core."""
    reach = np.maximum.accumulate(right[::-1])[::-1]  # the best gain from a place on
    r = np.searchsorted(-reach, left + core + 1e-9, side="right") - 1
    n = np.where(r >= 0, np.arange(len(r)) + r, -1)
    i = int(n.argmax())
    return (i, int(r[i])) if n[i] >= 0 else (0, 0)


def gapped_gain(a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the first i words of a: the best of matches less similarity times the longer side over the beginnings of b, then that beginning's words and its matches; words may be left out on either side."""
    row, widths = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
    gain, with_, got = np.zeros(len(a) + 1), np.zeros(len(a) + 1, np.int64), np.zeros(len(a) + 1, np.int64)
    for i, w in enumerate(a, 1):
        row[1:] = np.maximum(row[1:], np.where(b == w, row[:-1] + 1, 0))
        np.maximum.accumulate(row, out=row)
        worth = row - similarity * np.maximum(widths, i)
        j = int(worth.argmax())
        gain[i], with_[i], got[i] = worth[j], j, row[j]
    return gain, with_, got


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short runs, row by row."""
    if len(a) > len(b):
        a, b = b, a
    # Words alike at the start and at the end are part of a longest one.
    n = len(a)
    differ = np.flatnonzero(a != b[:n])
    if not len(differ):
        return n
    head = int(differ[0])
    differ = np.flatnonzero(a[head:][::-1] != b[len(b) - n + head :][::-1])
    tail = int(differ[0]) if len(differ) else n - head
    a, b = a[head : n - tail], b[head : len(b) - tail]
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        row[1:] = np.maximum(row[1:], np.where(b == w, row[:-1] + 1, 0))
        np.maximum.accumulate(row, out=row)
    return head + tail + int(row[-1])


def step_matches(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Matches of the words from each anchor of a chain to the next one's start, and of the last anchor."""
    edges_x, edges_y = np.append(x, x[-1] + k), np.append(y, y[-1] + k)
    if not np.diff(edges_x - edges_y).any():
        same = np.append(0, np.cumsum(a[x[0] : x[-1] + k] == b[y[0] : y[-1] + k]))
        return np.diff(same[edges_x - x[0]])
    got, across = np.diff(edges_x), np.diff(edges_y)
    level = np.flatnonzero(got == across)
    unlike = np.ones(len(x), bool)
    if len(level):
        on = np.append(0, np.cumsum(got[level]))
        differ = a[ranges(edges_x[level], got[level])] != b[ranges(edges_y[level], got[level])]
        unlike[level] = np.logical_or.reduceat(differ, on[:-1])
    for i in np.flatnonzero(unlike):
        got[i] = common_words(a[edges_x[i] : edges_x[i + 1]], b[edges_y[i] : edges_y[i + 1]])
    return got


def align(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, similarity: float, margin: int, min_words: int, cut_before: bool = False, cut_behind: bool = False) -> tuple[list[tuple[int, int, int, int, int]], bool]:
    """(start, end, start, end, matches) of the passages around a chain's anchors in the words a and b, and whether a wider margin may show more.

    One for the whole chain if matches are at least similarity times the longer side. Else those of
    its stretches for which that holds and that lie in no longer such stretch; two of them
    may overlap. A stretch starts and ends at anchors, with and without the words that go on alike.
    cut_before, cut_behind: both documents go on beyond the ends of a and b."""
    got = step_matches(a, b, x, y, k)
    left, more_left, wide = extend(a[: x[0]][::-1], b[: y[0]][::-1])
    right, more_right, wide_right = extend(a[x[-1] + k :], b[y[-1] + k :])
    wide = wide and cut_before or wide_right and cut_behind
    whole = (int(x[0] - left), int(x[-1] + k + right), int(y[0] - left), int(y[-1] + k + right), int(got.sum()) + more_left + more_right)
    if whole[1] - whole[0] < min_words and not wide:
        # Ends at the highest score may be short of min_words where a longer stretch is alike enough.
        span = max(x[-1] - x[0], y[-1] - y[0]) + k
        before, behind = (a[: x[0]][::-1], b[: y[0]][::-1]), (a[x[-1] + k :], b[y[-1] + k :])
        sides = [u[:n] == v[:n] for u, v in (before, behind) for n in [min(len(u), len(v), min_words)]]
        core = got.sum() - similarity * span
        left, right = longest(core, *(np.append(0.0, np.cumsum(m - similarity)) for m in sides))
        if x[-1] - x[0] + k + left + right < min_words and 2 * span >= min_words:
            # Words left out near the ends: the same with gaps.
            gains = [gapped_gain(u[:min_words], v[:min_words], similarity) for u, v in (before, behind)]
            i, j = longest(core, gains[0][0], gains[1][0])
            if x[-1] - x[0] + k + i + j >= min_words:
                (_, with_l, got_l), (_, with_r, got_r) = gains
                whole = (int(x[0] - i), int(x[-1] + k + j), int(y[0] - with_l[i]), int(y[-1] + k + with_r[j]), int(got.sum() + got_l[i] + got_r[j]))
        elif x[-1] - x[0] + k + left + right >= min_words:
            whole = (int(x[0] - left), int(x[-1] + k + right), int(y[0] - left), int(y[-1] + k + right), int(got.sum() + sides[0][:left].sum() + sides[1][:right].sum()))
    if whole[4] >= similarity * max(whole[1] - whole[0], whole[3] - whole[2]) - 1e-9:
        return [whole], wide
    # A cut between two anchors is of use only where words differ between them.
    cut = np.flatnonzero(got[:-1] < np.maximum(np.diff(x), np.diff(y)))
    before = np.append(0, np.cumsum(got[:-1]))
    starts, ends = [], []
    for i in (0, *(cut + 1).tolist()):
        n, more, open_ = extend(a[max(x[i] - margin, 0) : x[i]][::-1], b[max(y[i] - margin, 0) : y[i]][::-1])
        wide |= open_ and min(x[i], y[i]) > margin
        starts += [(x[i] - m, y[i] - m, before[i] - e, i) for m, e in {(n, more), (0, 0)}]
    for i in (*cut.tolist(), len(x) - 1):
        n, more, open_ = extend(a[x[i] + k :][:margin], b[y[i] + k :][:margin])
        wide |= open_ and min(len(a) - x[i], len(b) - y[i]) - k > margin
        ends += [(x[i] + k + m, y[i] + k + m, before[i] + k + e, i) for m, e in {(n, more), (0, 0)}]
    end_x, end_y, upto, last = np.array(sorted(ends)).T
    out, reached = [], -1
    for start_x, start_y, gone, i in sorted(starts):
        matches = upto - gone
        fit = np.flatnonzero((last >= i) & (end_x > reached) & (matches >= similarity * np.maximum(end_x - start_x, end_y - start_y)))
        if len(fit):
            j = fit[-1]
            reached = end_x[j]
            out.append((int(start_x), int(end_x[j]), int(start_y), int(end_y[j]), int(matches[j])))
    return out, bool(wide)


def _ends_alike(a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, size: np.ndarray, step: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(same, there), a row for each end: whether the words of a and b from two places on, forwards or backwards, are alike, and which of them there are."""
    on = np.arange(most)
    there = on < size[:, None]
    same = np.take(a, from_a[:, None] + step * on, mode="clip") == np.take(b, from_b[:, None] + step * on, mode="clip")
    return same & there, there


def _extended(same: np.ndarray, there: np.ndarray, drop: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(words, open) of extend(), a row for each end."""
    score = np.cumsum(np.where(there, np.where(same, 1, -2), -4 * same.shape[1] - drop), axis=1, dtype=np.int32)
    fallen = np.maximum.accumulate(np.maximum(score, 0), axis=1) - score > drop
    fallen = np.logical_or.accumulate(fallen, axis=1)
    best = np.where(fallen, 0, score)
    words = np.where(best.max(axis=1) > 0, best.argmax(axis=1) + 1, 0)
    return words, there[:, 0] & ~(fallen & there).any(axis=1)


def may_be_long(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], low: np.ndarray, more: np.ndarray, k: int, similarity: float, margin: int, min_words: int) -> np.ndarray:
    """For each chain, whether align() may find min_words words or ask for more words around it; False only where it surely does neither.

    Lists as (offsets, values): the words of both sides and the places of anchors in them; low, more: their first words
    follow others in both documents, others follow their last words in both. Told for chains at one shift and of less than
    half of min_words, which is most of those that common phrases make: their ends grow along that shift alone, so from no anchor
    further than from the outer ones, and align() puts no gaps there."""
    out = np.ones(len(low), bool)
    if not min_words <= margin <= 256:
        return out
    shift = x[1] - y[1]
    one = np.maximum.reduceat(shift, x[0][:-1]) == np.minimum.reduceat(shift, x[0][:-1])
    head, tail = x[1][x[0][:-1]], x[1][x[0][1:] - 1] + k
    span = tail - head
    c = np.flatnonzero(one & (2 * span < min_words))
    if not len(c):
        return out
    head, tail, span, low, more = head[c], tail[c], span[c], low[c], more[c]
    other, size_a, size_b = head - shift[x[0][c]], np.diff(a[0])[c], np.diff(b[0])[c]
    at, to = a[0][c] + head, b[0][c] + other
    ends = [_ends_alike(a[1], b[1], at - 1, to - 1, np.minimum(head, other), -1, margin), _ends_alike(a[1], b[1], at + span, to + span, np.minimum(size_a - tail, size_b - other - span), 1, margin)]
    (left, open_left), (right, open_right) = (_extended(*e) for e in ends)
    found = (span + left + right >= min_words) | open_left & low | open_right & more
    # Longer ends that are alike enough all the same: longest(), from the most that the core may add.
    before, behind = (np.hstack([np.zeros((len(c), 1)), np.cumsum(np.where(there, same - similarity, -np.inf), axis=1)])[:, : min_words + 1] for same, there in ends)
    behind = np.maximum.accumulate(behind[:, ::-1], axis=1)[:, ::-1]
    rest = np.maximum((min_words - span)[:, None] - np.arange(min_words + 1), 0)
    found |= (before + np.take_along_axis(behind, rest, axis=1) + ((1 - similarity) * span)[:, None] >= -1e-6).any(axis=1)
    out[c] = found
    return out


def own_repeats(words: np.ndarray, at: np.ndarray, to: np.ndarray, k: int, gap_cost: float, min_words: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """Passages of a document that stand in it before; at, to: places of seeds and where each stands last before."""
    out = []
    for part in chain(at, to, k, gap_cost):
        x, y = at[part], to[part]
        out += [p for p in align(words, words, x, y, k, similarity, len(words), min_words)[0] if p[1] - p[0] >= min_words]
    return out


@without_old_shuffles
def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, sparse: int = 4, window: int = 40, few: int = 4, alike: int = 9, gap_cost: float = 0.02, min_words: int = 50, similarity: float = 0.8, margin: int = 64, request_rows: int = 200) -> DataFrame:
    """Pairs of passages of at least min_words words that a document shares with an earlier one, or with an earlier place of its own.

    Columns: id, start, end, other_id, other_start, other_end (words, end exclusive), matches and
    identity (matches over the longer side, at least similarity). Words are lower-cased runs of
    other than ASCII white space.

    Seeds are k-mers, one in `sparse` by their hash (see seed_places). In a document, each place of
    a seed but the first is joined with the place before. First places are joined with those in
    earlier documents: with all of them for seeds in up to `few` documents, else with the first
    holder (the least id), which stands for all, and with the first that holds it where the least hash of the 24 words before, or of those behind,
    is the same; so a passage in n documents gives n - 1 pairs at least, and common lines put together anew meet where they were put together so first.
    Changed passages made of such seeds alone may so be told with another holder than the likest, or be missed. `few` above the number of documents lets
    all holders of every seed meet, with no such loss: the same joins, spread over tasks, but pairs grow with the square of a seed's holders.
    Anchors are left out unless at least `alike` of 64 bits agree that stand for the 12 words on either side, in any order. Where the holder or the shift changes from
    a seed to the next and all seeds around occur before, each run of min_words equal words is
    joined with its own first holder too: later holders of a passage of common pieces meet there.
    Anchors of a pair of documents are chained and each chain is aligned, and parted where it isn't
    alike enough as a whole. Ends are grown word by word; where they reach the `margin`
    around the chain, the chain is aligned again with 64 times the margin, until none does.

    Null, empty and short texts have no passages, nor have rows with a null id. Rows that repeat an
    id are one document, of which the longest text (of these the greatest) speaks. Ties between
    holders go to the least id and its first place. Texts may be of any length. Other columns don't
    matter; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    window = max(1, min(window, min_words - k + 1, (1 << GAP) - 1))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    again = staged(rows.groupBy("id").count().where("count > 1").select("id"))
    if not again.isEmpty():
        best = rows.join(again, "id").groupBy("id").agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("m"))
        rows = rows.join(again, "id", "left_anti").union(best.select("id", "m.text"))
    kind, arrow = rows.schema[0].dataType.simpleString(), arrow_type(rows, "id")
    ints = pa.list_(pa.int32())

    def find_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First places of seeds (seed, spot), further ones (to, spot), and passages within a document (span)."""
        for b in batches:
            ids = b.column(0)
            for lo in range(0, len(ids), 500):
                owner, seeds, spots, contexts, near, to, spans, i = [], [], [], [], [], [], [], lo
                for words in scan([t.lower() for t in b.column(1)[lo : lo + 500].to_pylist()]):
                    h = words.hashes()
                    at, found = seed_places(h, k, sparse, window, words.first)
                    if len(at):
                        doc = np.searchsorted(words.first, at, side="right") - 1
                        place = at - words.first[doc]
                        order = np.argsort(found, kind="stable")  # those of one document stay in a row
                        last = np.full(len(at), -1, np.int32)
                        same = np.flatnonzero((found[order[1:]] == found[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]))
                        last[order[same + 1]] = place[order[same]]
                        owner.append(i + doc)
                        seeds.append(found.view(np.int64))
                        for x, y in zip((spots, contexts, near), spots_of(h, at, k, words.first), strict=True):
                            x.append(y)
                        to.append(last)
                        here = np.flatnonzero(last >= 0)
                        bounds = np.flatnonzero(np.diff(doc[here], prepend=-1, append=len(words.texts)))
                        for u, v in itertools.pairwise(bounds.tolist()):
                            d, some = int(doc[here[u]]), here[u:v]
                            spans += [(i + d, s) for s in own_repeats(h[words.first[d] : words.first[d + 1]], place[some], last[some].astype(np.int64), k, gap_cost, min_words, similarity)]
                    i += len(words.texts)
                if owner:
                    first = np.concatenate(to) < 0
                    columns = [ids.take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(seeds), mask=~first), pa.array(np.concatenate(spots)), *(pa.array(np.concatenate(x), mask=~first) for x in (contexts, near)), pa.array(np.concatenate(to), mask=first), pa.nulls(len(first), ints)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                if spans:
                    n = len(spans)
                    columns = [ids.take(pa.array([i for i, _ in spans])), *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.int32()), pa.array([s for _, s in spans], ints)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "seed", "spot", "context", "near", "to", "span"]
    scanned = staged(rows.mapInArrow(find_seeds, f"id {kind}, seed long, spot long, context long, near long, to int, span array<int>"))
    seeds = scanned.where("seed is not null").select("id", "seed", "spot", "context", "near")
    first = seeds.groupBy("seed").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    own = scanned.where("span is not null").select("id", *(F.col("span")[i].cast("long").alias(n) for i, n in ((0, "start"), (1, "end"))), F.col("id").alias("other_id"), *(F.col("span")[i].cast("long").alias(n) for i, n in ((2, "other_start"), (3, "other_end"), (4, "matches"))))
    own = staged(own)
    further = staged(scanned.where("to is not null").select("id", "spot", "to"))
    # Most seeds stand in one document: bitmaps of the others spare their shuffle. Both sides of the join are read back, so that AQE splits it at hot seeds.
    first = staged(first)
    bits = 1 << min(max((8 * first.count()).bit_length(), 20), 30)
    shared = staged(perhaps_in(seeds, first, "seed", bits).join(first.hint("shuffle_hash"), "seed"))
    unstaged(scanned, first)
    holders = staged(shared.where("id = first").select("seed", F.col("spot").alias("other_spot"), F.col("context").alias("other_context")))
    by_first = staged(shared.where("id <> first").join(holders.hint("shuffle_hash"), "seed").withColumnRenamed("first", "other").drop("seed", "near"))
    several = shared.where(F.col("n").between(3, few)).select("seed", F.struct("id", "spot", "context").alias("a"))
    if few <= LISTED:
        lists = several.groupBy("seed").agg(F.collect_list("a").alias("in"))
        each = lists.select(F.explode("in").alias("a"), "in").select("a", F.explode("in").alias("b")).where("a.id > b.id")
    else:  # a seed's holders fill no row of a task, and AQE splits hot seeds
        each = several.join(several.withColumnRenamed("a", "b").hint("merge"), "seed").where("a.id > b.id")
    anchors = by_first.where((F.col("n") > few) | (F.col("n") == 2)).drop("n").unionByName(each.select("a.*", F.col("b.id").alias("other"), F.col("b.spot").alias("other_spot"), F.col("b.context").alias("other_context")))
    # Seeds of many holders: the first in like surroundings, on either side.
    sides = F.array(F.shiftright("near", 32), F.col("near").bitwiseAND(F.lit(0xFFFFFFFF)))
    like = shared.where(F.col("n") > few).select("id", "spot", "context", "first", "seed", F.posexplode(sides).alias("side", "least")).withColumn("key", F.xxhash64("seed", "side", "least")).drop("seed", "side", "least")
    heads = like.groupBy("key").agg(F.min(F.struct("id", "spot", "context")).alias("head"), F.count("*").alias("n")).where("n > 1").select("key", F.col("head.id").alias("other"), F.col("head.spot").alias("other_spot"), F.col("head.context").alias("other_context"))
    heads = staged(heads)
    like = like.join(heads.hint("shuffle_hash"), "key").where((F.col("id") != F.col("other")) & (F.col("first") != F.col("other")))
    anchors = anchors.unionByName(like.select(*anchors.columns))
    anchors = anchors.where(alike_around(F.col("context"), F.col("other_context")) >= alike).select("id", "other", place(F.col("spot")).alias("at"), place(F.col("other_spot")).alias("to"))

    # Second round: runs of min_words words that no single first holder may have whole, though a later holder may.
    def find_joints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, held = b.column(0), b.column(1).flatten()
            doc = np.repeat(np.arange(len(ids)), b.column(1).value_lengths().to_numpy(zero_copy_only=False))
            spots, to = (held.field(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            found = joints(doc, spots, held.field(1).dictionary_encode().indices.to_numpy(zero_copy_only=False), to, k, min_words)
            columns = list(zip(*found, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int32()) for c in columns[1:])], names=["id", "lo", "hi"])

    held = by_first.select("id", "spot", "other", place(F.col("other_spot")).alias("to")).union(further.select("id", "spot", F.col("id").alias("other"), "to"))
    by_doc = held.groupBy("id").agg(F.collect_list(F.struct("spot", "other", "to")).alias("held"))
    spots = staged(by_doc.mapInArrow(find_joints, f"id {kind}, lo int, hi int").groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spots")))

    unstaged(further)

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo in range(0, len(ids), 50):
                asked, i = b.column(2)[lo : lo + 50], 0
                counts, asked = asked.value_lengths().to_numpy(zero_copy_only=False), asked.flatten()
                upto = np.append(0, np.cumsum(counts))
                least, most = (asked.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (0, 1))
                for words in scan([t.lower() for t in b.column(1)[lo : lo + 50].to_pylist()]):
                    n = len(words.texts)
                    some = slice(upto[i], upto[i + n])
                    doc = np.repeat(np.arange(n), counts[i : i + n])
                    begin = words.first[doc]
                    size = np.maximum(np.minimum(most[some] + 1, words.first[doc + 1] - begin - min_words + 1) - least[some], 0)
                    places = ranges(least[some], size)
                    found = long_grams(words.hashes(), min_words)[places + np.repeat(begin, size)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + i + np.repeat(doc, size))), pa.array(places.astype(np.int32)), pa.array(found.view(np.int64))], names=["id", "at", "run"])
                    i += n

    runs = staged(perhaps_in(rows, spots).join(spots.hint("shuffle_hash"), "id").select("id", "text", "spots").mapInArrow(find_runs, f"id {kind}, at int, run long"))
    whole = runs.groupBy("run").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    whole = runs.join(staged(whole), "run")
    to = staged(whole.where("id = first").groupBy("run").agg(F.min("at").alias("to")))
    late = whole.where("id <> first").join(to, "run")
    late = late.select("id", "first", "at", "to", F.explode(F.array(F.lit(0), F.lit(min_words - k))).alias("on")).select("id", F.col("first").alias("other"), (F.col("at") + F.col("on")).alias("at"), (F.col("to") + F.col("on")).alias("to"))
    anchors = anchors.union(late).groupBy("id", "other").agg(F.collect_list(F.struct("at", "to")).alias("anchors"))

    def make_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "other", "part", "x", "y"]
        for b in batches:
            ids, others, flat, n = b.column(0), b.column(1), b.column(2).flatten(), b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            one, out = np.flatnonzero(n == 1), []
            if len(one):
                offsets, at = pa.array(np.arange(len(one) + 1, dtype=np.int32)), pa.array(ends[one] - 1)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(one)), others.take(pa.array(one)), pa.array(np.zeros(len(one), np.int32)), *(pa.ListArray.from_arrays(offsets, flat.field(i).take(at)) for i in (0, 1))], names=names)
            x, y = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for i in np.flatnonzero(n > 1).tolist():
                both = np.unique(x[ends[i] - n[i] : ends[i]] << 32 | y[ends[i] - n[i] : ends[i]])
                u, v = both >> 32, both & 0xFFFFFFFF
                for part, at in enumerate(chain(u, v, k, gap_cost)):
                    out.append((i, part, u[at], v[at]))
            if out:
                columns = list(zip(*out, strict=True))
                at = pa.array(columns[0], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(at), others.take(at), pa.array(columns[1], pa.int32()), *(pa.array(c, ints) for c in columns[2:])], names=names)

    chains = staged(anchors.mapInArrow(make_chains, f"id {kind}, other {kind}, part int, x array<int>, y array<int>"))
    unstaged(shared, holders, by_first, runs)
    done = [own]
    while True:
        found = _align_chains(rows, chains, k, margin, similarity, min_words, request_rows)
        done.append(found.where("not wide").drop("wide", "part"))
        wide = found.where("wide").select("id", F.col("other_id").alias("other"), "part").distinct()
        if wide.isEmpty():
            break
        chains, margin = staged(chains.join(wide, ["id", "other", "part"], "left_semi")), 64 * margin
    spans = functools.reduce(DataFrame.unionByName, done)
    spans = spans.withColumn("identity", F.col("matches") / F.greatest(F.col("end") - F.col("start"), F.col("other_end") - F.col("other_start"))).where(F.col("identity") >= similarity - 1e-9)
    spans = spans.where(F.col("end") - F.col("start") >= min_words)
    return spans.select(F.col("id").alias(id_col), "start", "end", "other_id", "other_start", "other_end", "matches", "identity")


def _align_chains(rows: DataFrame, chains: DataFrame, k: int, margin: int, similarity: float, min_words: int, request_rows: int) -> DataFrame:
    """Passages of all chains, with margin words around each; wide: the chain's may go on beyond (then a row without places)."""
    kind, arrow = rows.schema[0].dataType.simpleString(), arrow_type(rows, "id")
    # The words around each chain (as 32-bit hashes), from both documents: a document is read once for up to request_rows chains.
    sides = []
    for side, doc, at in ((0, "id", "x"), (1, "other", "y")):
        lo, hi = F.greatest(F.col(at)[0] - margin, F.lit(0)), F.element_at(at, -1) + k + margin
        anchors = [F.when(F.lit(side == 0), F.col(c)).alias(c) for c in "xy"]  # they travel with the one side
        sides.append(chains.select(F.col(doc).alias("doc"), F.struct("id", "other", "part", F.lit(side).alias("side"), lo.alias("lo"), hi.alias("hi"), *anchors).alias("ask")))
    asks = sides[0].union(sides[1])
    sizes = staged(asks.groupBy("doc").agg(F.ceil(F.count("*") / request_rows).alias("heaps")).where("heaps > 1"))
    heap = F.pmod(F.xxhash64("ask.id", "ask.other", "ask.part", "ask.side"), F.coalesce("heaps", F.lit(1)))
    asks = asks.join(if_small(sizes, 100_000), "doc", "left").withColumn("heap", heap)
    asks = staged(asks.groupBy("doc", "heap").agg(F.collect_list("ask").alias("asks")).withColumnRenamed("doc", "id"))
    texts = perhaps_in(rows, asks).join(asks.hint("shuffle_hash"), "id").select("text", "asks")

    names = ["id", "other", "part", "side", "lo", "more", "words", "x", "y"]
    ints = pa.list_(pa.int32())

    def read_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 50):
                asked, i = b.column(1)[lo : lo + 50], 0
                upto, asked = np.append(0, np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False))), asked.flatten()
                column = {asked.type.field(j).name: x for j, x in enumerate(asked.flatten())}
                low, high = (column[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi"))
                for words in scan([t.lower() for t in b.column(0)[lo : lo + 50].to_pylist()]):
                    h, n = words.hashes().astype(np.uint32).view(np.int32), len(words.texts)
                    some = slice(upto[i], upto[i + n])
                    doc = np.repeat(np.arange(n), np.diff(upto[i : i + n + 1]))
                    begin, length = words.first[doc], (words.first[1:] - words.first[:-1])[doc]
                    size, more = np.maximum(np.minimum(high[some], length) - low[some], 0), high[some] < length
                    ends = np.append(0, np.cumsum(size))
                    u = 0
                    while u < len(doc):  # many documents may ask for all of a long one
                        v = max(u + 1, int(np.searchsorted(ends, ends[u] + 1_000_000, side="right")) - 1)
                        cut, taken = slice(some.start + u, some.start + v), h[ranges((begin + low[some])[u:v], size[u:v])]
                        parts = [column[c].slice(cut.start, v - u) for c in ("id", "other", "part", "side", "lo")]
                        lists = pa.ListArray.from_arrays(pa.array((ends[u : v + 1] - ends[u]).astype(np.int32)), pa.array(taken))
                        yield pa.RecordBatch.from_arrays([*parts, pa.array(more[u:v]), lists, *(column[c].slice(cut.start, v - u) for c in "xy")], names=names)
                        u = v
                    i += n

    read = staged(texts.mapInArrow(read_words, f"id {kind}, other {kind}, part int, side int, lo int, more boolean, words array<int>, x array<int>, y array<int>"))
    one_of = lambda side, x, *more: read.where(F.col("side") == side).select("id", "other", "part", *(F.col(c).alias(f"{c}_{x}") for c in ("lo", "more", "words")), *more)
    both = one_of(0, "x", "x", "y").join(one_of(1, "y"), ["id", "other", "part"])

    def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))), lists.flatten().to_numpy(zero_copy_only=False)

    def make_alignments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out = []
            p, q, more_x, more_y = (b.column(n).to_numpy(zero_copy_only=False) for n in ("lo_x", "lo_y", "more_x", "more_y"))
            low, more = (p > 0) & (q > 0), more_x & more_y
            (o, a), (u, w), (o_x, x), (o_y, y) = (flat(b.column(n)) for n in ("words_x", "words_y", "x", "y"))
            x, y = x - np.repeat(p, np.diff(o_x)), y - np.repeat(q, np.diff(o_y))
            ask = np.flatnonzero(may_be_long((o, a), (u, w), (o_x, x), (o_y, y), low, more, k, similarity, margin, min_words))
            ids, others, parts = (b.column(n).take(pa.array(ask)).to_pylist() for n in ("id", "other", "part"))
            for j, i in enumerate(ask.tolist()):
                found, wide = align(a[o[i] : o[i + 1]], w[u[i] : u[i + 1]], x[o_x[i] : o_x[i + 1]], y[o_y[i] : o_y[i + 1]], k, similarity, margin, min_words, bool(low[i]), bool(more[i]))
                if wide:
                    out.append((ids[j], None, None, others[j], None, None, None, parts[j], True))
                else:
                    out += [(ids[j], int(s + p[i]), int(e + p[i]), others[j], int(t + q[i]), int(f + q[i]), m, parts[j], False) for s, e, t, f, m in found if e - s >= min_words]
            columns = list(zip(*out, strict=True)) or [[]] * 9
            kinds = (arrow, pa.int64(), pa.int64(), arrow, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "start", "end", "other_id", "other_start", "other_end", "matches", "part", "wide"])

    found = staged(both.mapInArrow(make_alignments, f"id {kind}, start long, end long, other_id {kind}, other_start long, other_end long, matches long, part int, wide boolean"))
    unstaged(asks, read)
    return found

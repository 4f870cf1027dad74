"""Passages that were changed by replaced, inserted and left-out words, and passages put together of common lines."""

import random
from collections import Counter

import numpy as np

from eventweave.llm import substring
from eventweave.llm.substring import NEAR, WIDE, gapped_gain, longest, shared_passages, spots_of
from eventweave.llm.words import mix

#: What is done to a passage of 80 words, at every n-th word or with a chance: identity lies at 0.8 to 0.9.
KINDS = {"rep7": ("rep", 7), "rep10": ("rep", 10), "rep.15": ("rep", 0.15), "ins5": ("ins", 5), "ins8": ("ins", 8), "ins.18": ("ins", 0.18), "del6": ("del", 6), "del10": ("del", 10), "del.12": ("del", 0.12), "alt6": ("alt", 6), "alt.17": ("alt", 0.17), "rep5": ("rep", 5)}


def word(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))


def edited(words, rng, kind, n):
    out, turn = [], 0
    for i, w in enumerate(words):
        if i % n != n - 1 if isinstance(n, int) else rng.random() >= n:
            out.append(w)
            continue
        what, turn = ("ins", "del")[turn % 2] if kind == "alt" else kind, turn + 1
        out += {"rep": [word(rng)], "ins": [w, word(rng)], "del": []}[what]
    return out


def test_changed_passages_are_told(spark):
    rng, docs, pairs, each = random.Random(17), [], {}, 120
    usual = [word(rng) for _ in range(3000)]
    around = lambda n: [rng.choice(usual) for _ in range(n)]

    def add(passage, before, behind):
        docs.append((len(docs), " ".join(around(before) + passage + around(behind))))
        return len(docs) - 1

    for name, (kind, n) in KINDS.items():
        for _ in range(each):
            passage = [word(rng) for _ in range(80)]
            first = add(passage, 60, 60)
            pairs[add(edited(passage, rng, kind, n), 40, 80), first] = name
    # Lines of 12 words in five documents each, then passages of five such lines, exact to the first holder and changed.
    lines = [[word(rng) for _ in range(12)] for _ in range(5 * each)]
    order = [i for i in range(len(lines)) for _ in range(5)]
    rng.shuffle(order)
    for i in order:
        add(lines[i], 30, 30)
    for j in range(each):
        passage = sum(lines[5 * j : 5 * j + 5], [])
        first = add(passage, 30, 30)
        pairs[add(edited(passage, rng, "rep", 7), 20, 30), first] = "lines"
    rows = shared_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()
    found = {(r.doc_id, r.other_id) for r in rows}
    assert found <= set(pairs)
    told = Counter(pairs[p] for p in found)
    assert all(told[name] >= 0.9 * each for name in (*KINDS, "lines")), told
    assert all(r.identity >= 0.8 - 1e-9 and r.end - r.start >= 50 for r in rows)


def test_all_holders_meet(spark, monkeypatch):
    """Edited passages of lines that five documents hold: with few beyond all holders each is told with its own original; lists and joins of holders agree."""
    rng, docs, pairs, each = random.Random(23), [], set(), 60
    around = lambda n: [word(rng) for _ in range(n)]
    lines = [around(12) for _ in range(5 * each)]
    order = [i for i in range(len(lines)) for _ in range(5)]
    rng.shuffle(order)
    for i in order:
        docs.append((len(docs), " ".join(around(30) + lines[i] + around(30))))
    for j in range(each):
        passage = sum(lines[5 * j : 5 * j + 5], [])
        docs += [(len(docs), " ".join(around(30) + passage + around(30))), (len(docs) + 1, " ".join(around(20) + edited(passage, rng, "rep", 7) + around(30)))]
        pairs.add((len(docs) - 1, len(docs) - 2))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    joined = sorted(map(tuple, shared_passages(table, few=1 << 40).collect()))
    assert {r[0] for r in joined} == {a for a, _ in pairs} and {(r[0], r[3]) for r in joined} == pairs
    monkeypatch.setattr(substring, "LISTED", 1 << 40)
    assert sorted(map(tuple, shared_passages(table, few=1 << 40).collect())) == joined


def test_contexts_hold_the_words_around():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 63, 90).astype(np.uint64)
    at = np.array([0, 3, 20, 50, 84, 86])
    _, context, near = spots_of(words, at, 4)
    for p, c, m in zip(at.tolist(), context.view(np.uint64).tolist(), near.view(np.uint64).tolist(), strict=True):
        sides = lambda n: (words[max(p - n, 0) : p], words[p + 4 : p + 4 + n])  # noqa: B023, E731
        assert c == sum({1 << int(w & np.uint64(63)) for x in sides(NEAR) for w in x})
        least = [min([int(v >> np.uint64(32)) for v in mix(x)], default=(1 << 32) - 1) if len(x) else (1 << 32) - 1 for x in sides(WIDE)]
        assert m == least[0] << 32 | least[1]


def test_gains_with_gaps_against_all_choices():
    rng = random.Random(5)
    for _ in range(30):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randrange(0, 9))], np.int64) for _ in range(2))
        gain, words, got = gapped_gain(a, b, 0.8)
        for i in range(len(a) + 1):
            table = [[0] * (len(b) + 1) for _ in range(i + 1)]
            for x in range(1, i + 1):
                for y in range(1, len(b) + 1):
                    table[x][y] = table[x - 1][y - 1] + 1 if a[x - 1] == b[y - 1] else max(table[x - 1][y], table[x][y - 1])
            best = max(table[i][y] - 0.8 * max(i, y) for y in range(len(b) + 1)) if i else 0.0
            assert abs(gain[i] - best) < 1e-9 and (not i or abs(got[i] - 0.8 * max(i, words[i]) - best) < 1e-9)
        left, right = gain, gapped_gain(b, a, 0.8)[0]
        core = rng.random() * 3
        i, j = longest(core, left, right)
        fit = [x + y for x in range(len(left)) for y in range(len(right)) if core + left[x] + right[y] >= -1e-9]
        assert i + j == max(fit, default=0)

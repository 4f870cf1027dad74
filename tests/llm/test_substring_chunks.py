"""Steps of op2 that take whole chunks of documents or chains at once, against each document or chain alone."""

import itertools

import numpy as np
import pytest

from eventweave.llm.common import without_old_shuffles
from eventweave.llm.substring import align, chain, long_grams, may_be_long, seed_places, spots_of, step_matches


def documents(rng, n=40):
    """(words, first): documents of up to 300 words from a small vocabulary, some empty or short."""
    first = np.append(0, np.cumsum(rng.integers(0, 300, n) * (rng.random(n) > 0.2) + rng.integers(0, 5, n)))
    return rng.choice(rng.integers(0, 1 << 63, 200).astype(np.uint64), first[-1]), first


def test_seeds_of_a_chunk_are_those_of_its_documents():
    """Seeds and what stands around them are found for a chunk of documents in one go, and are what each document has alone."""
    rng = np.random.default_rng(3)
    for k, sparse, window in ((4, 4, 40), (4, 64, 5), (1, 3, 2), (2, 9, 4)):
        for _ in range(10):
            words, first = documents(rng)
            at, found = seed_places(words, k, sparse, window, first)
            alone = [seed_places(words[p:q], k, sparse, window) for p, q in itertools.pairwise(first)]
            assert at.tolist() == [x + p for p, (places, _) in zip(first[:-1], alone, strict=True) for x in places]
            assert found.tolist() == [x for _, hashes in alone for x in hashes]
            spots = [spots_of(words[p:q], places, k) for (p, q), (places, _) in zip(itertools.pairwise(first), alone, strict=True)]
            assert [x.tolist() for x in spots_of(words, at, k, first)] == [[x for s in spots for x in s[i]] for i in range(3)]


def test_long_runs_are_hashed_by_their_words_alone():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 32, 50):
        words = np.tile(rng.integers(0, 1 << 63, 60).astype(np.uint64), 3)
        runs = [tuple(words[i : i + n].tolist()) for i in range(len(words) - n + 1)]
        got = long_grams(words, n).tolist()
        assert len(got) == len(runs) and len(set(got)) == len(set(runs)) == len(set(zip(got, runs, strict=True)))
        assert not len(long_grams(words[: n - 1], n))


def test_chains_at_one_shift_are_those_of_the_tree():
    """Against a plain search over all anchors before."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        x = np.sort(rng.choice(int(rng.choice([60, 400, 5000])), int(rng.integers(1, 40)), replace=False))
        y, n = x + int(rng.integers(0, 50)), len(x)
        score, back = [4.0] * n, [-1] * n
        for j in range(n):
            options = [(score[m] + min(4, x[j] - x[m]) - 0.02 * 2 * (x[j] - x[m] - 4), m) for m in range(j)]
            if options and (best := max(options))[0] > 4 + 1e-9:
                score[j], back[j] = best
        links = {(back[j], j) for j in range(n) if back[j] >= 0}
        parts = [p.tolist() for p in chain(x, y, 4, 0.02)]
        assert sorted(i for p in parts for i in p) == list(range(n))
        assert {pair for p in parts for pair in itertools.pairwise(p)} <= links
        assert sum(len(p) - 1 for p in parts) >= len(links) - sum(1 for p in parts if back[p[0]] >= 0)


def test_matches_between_anchors():
    """Of a chain whose shift changes: the longest common subsequence of each step."""
    rng = np.random.default_rng(6)

    def plain(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            rows[i + 1][j + 1] = rows[i][j] + 1 if a[i] == b[j] else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    for _ in range(300):
        n = int(rng.integers(1, 6))
        a, b = rng.integers(0, 4, 60), rng.integers(0, 4, 60)
        x, y = (np.sort(rng.choice(50, n, replace=False)) for _ in "xy")
        if rng.random() < 0.5:
            b[y[0] : y[0] + 9] = a[x[0] : x[0] + 9]
        if len(set((x - y).tolist())) == 1:
            continue  # places are then compared one by one
        to_x, to_y = np.append(x, x[-1] + 4), np.append(y, y[-1] + 4)
        assert step_matches(a, b, x, y, 4).tolist() == [plain(a[to_x[i] : to_x[i + 1]], b[to_y[i] : to_y[i + 1]]) for i in range(n)]


def test_few_short_chains_are_aligned():
    """Chains that common phrases make are told from long ones all at once: align() finds nothing in those left out, and few of those kept are short."""
    rng = np.random.default_rng(7)
    columns, low, more = [[] for _ in range(4)], [], []
    for _ in range(4000):
        n, m = (int(v) for v in rng.integers(4, 133, 2))
        a, b = rng.integers(0, 50, n), rng.integers(0, 50, m)
        size = int(rng.integers(4, min(n, m, 90) + 1)) if rng.random() < 0.3 else 4
        p, q = int(rng.integers(0, min(n - size, 64) + 1)), int(rng.integers(0, min(m - size, 64) + 1))
        b[q : q + size] = np.where(rng.random(size) < rng.choice([0, 0.1, 0.2]), 99, a[p : p + size])
        middle = int(rng.integers(0, size - 3))
        b[q + middle : q + middle + 4] = a[p + middle : p + middle + 4]
        x = np.unique([middle, *rng.integers(0, size - 3, int(rng.integers(0, 3)))])
        x = x[x <= middle + 20]
        shifts = rng.integers(0, 2, len(x)) * (rng.random() < 0.1)
        for c, v in zip(columns, (a, b, x + p, np.minimum(x + q + np.maximum.accumulate(shifts), m - 4)), strict=True):
            c.append(v)
        low.append(rng.random() < 0.5)
        more.append(rng.random() < 0.5)
    lists = [(np.append(0, np.cumsum([len(v) for v in c])), np.concatenate(c)) for c in columns]
    kept = may_be_long(*lists, np.array(low), np.array(more), 4, 0.8, 64, 50)
    told = []
    for a, b, x, y, before, behind in zip(*columns, low, more, strict=True):
        one = len(np.unique(x - y)) == 1 and np.all(np.diff(x) > 0)
        found, wide = align(a, b, x, y, 4, 0.8, 64, 50, before, behind) if one else ([(0, 50)], False)
        told.append(wide or any(p[1] - p[0] >= 50 for p in found))
    told = np.array(told)
    assert told[~kept].sum() == 0 and told.sum() > 200
    assert kept.sum() < 1.5 * told.sum() < len(kept)


def test_shuffle_files_go_with_their_step(spark):
    """The setting holds while the operator runs, also through an error, and is the session's own again afterwards."""
    key, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []

    @without_old_shuffles
    def step(rows, fail):
        seen.append(spark.conf.get(key))
        return 1 // (not fail)

    before = spark.conf.get(key)
    assert step(spark.range(1), fail=False) == 1 and spark.conf.get(key) == before
    with pytest.raises(ZeroDivisionError):
        step(spark.range(1), fail=True)
    assert seen == ["true", "true"] and spark.conf.get(key) == before

"""BPE automaton, centroid clustering and prefix trie against the library, brute force and odd rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventweave.llm import entry
from eventweave.llm.bpe_automaton import Encoder, TokenAutomaton, Vocabulary, bpe_decode, bpe_encode, letter_classes
from eventweave.llm.centroids import bounds, centroid_clusters, nearest, squared, whole_numbers, with_inertia
from eventweave.llm.common import prefix_sums
from eventweave.llm.prefix_trie import prefix_trie, rebuilt

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# op11


def test_bpe_query_is_the_library_s(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entry.op11_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_bpe_odd_texts(library):
    rng, encoder = random.Random(3), Encoder(PATH, letter_classes(), most=500)
    letters = "abcdeeettaoins    ABC0189.,;'!?-=_\n\t\x1c\x85éßß中文日本語の한국어🙂‍\xa0　'"
    parts = ["'re", "'ll", "'s", "don", "'", " ", "!", "r", "  ", "\n", "1", "<|endoftext|>", "<|end", " x"]
    label = encoder.automaton.label
    texts = ["", " ", "\n\n a", "a" * 3000, "= " * 700, "'" * 9, "'s's 't", " 's", "x 're", "<|endoftext|>" * 3, "a <|endoftext|>  \n", "日本" * 400]
    for k in range(3000):
        n = rng.choice((1, 3, 8, 30))
        texts.append("".join(rng.choice(parts if k % 3 == 0 else letters) for _ in range(n)))
        texts.append("".join(chr(rng.choice((rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)))) for _ in range(n)))
        texts.append("".join(rng.choice(label).decode("utf-8", "ignore") for _ in range(n)))
    ids, ends = encoder.encode(texts)
    expected = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == expected


def merged(text, merges):
    """Merges in order, each from left to right over the whole text."""
    out = list(text)
    for a, b, c in merges:
        i, new = 0, []
        while i < len(out):
            if out[i : i + 2] == [a, b]:
                new.append(c)
                i += 2
            else:
                new.append(out[i])
                i += 1
        out = new
    return out


def test_automaton_paths_are_the_merged_texts():
    """Random merges over two letters: every short text's path is what merging gives, and arcs are exactly the pairs that occur."""
    rng = random.Random(11)
    for _ in range(40):
        label, merges = [b"a", b"b"], []
        while len(merges) < 9:
            a, b = rng.randrange(len(label)), rng.randrange(len(label))
            if label[a] + label[b] not in label:
                merges.append((a, b, len(label)))
                label.append(label[a] + label[b])
        automaton = TokenAutomaton(Vocabulary(label, merges, {}))
        pairs = set()
        for n in range(1, 11):
            for bits in range(1 << n):
                word = [bits >> i & 1 for i in range(n)]
                expected = merged(word, merges)
                assert automaton.encode(bytes(b"ab"[x] for x in word)) == expected
                pairs |= set(zip(expected, expected[1:]))
        for a, b in pairs:
            assert automaton.has_arc(a, b)
        for a in range(len(label)):
            for b in range(len(label)):
                if automaton.after[a] >= 0 and automaton.after[b] >= 0 and len(label[a] + label[b]) <= 10:
                    assert automaton.has_arc(a, b) == ((a, b) in pairs)
        assert len(automaton.base) == 1 + len(automaton.cuts)


def test_bpe_edges(spark, library):
    long = " ".join(f"word{i}" for i in range(30000))
    rows = [(1, "one two", "x"), (1, "one two", "x"), (None, None, "x"), (2, None, "x"), (3, "", "x"), (4, long, "x"), (5, "a" * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("__text", F.lit("y"))
    got = bpe_decode(bpe_encode(df, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((a or 0, b or "") for a, b, _ in rows)
    assert {r.doc_id: list(r.ids) for r in got}[4] == library.encode(long, add_special_tokens=False).ids
    assert bpe_encode(df.limit(0), PATH).collect() == []
    odd = spark.createDataFrame([(1, [220, None, 99999, 75, -1]), (2, None), (3, [447])], "doc_id long, ids array<int>")
    assert [r.text for r in bpe_decode(odd, PATH).orderBy("doc_id").collect()] == [" l", "", b"\xe2\x80".decode("utf-8", "replace")]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        Encoder(P.path("word_bpe_49k.json"), letter_classes())


# op12


def brute_clusters(rows, k=8, rounds=10, size=64):
    kept = [(i, [math.floor(x * 1024.0) if abs(x) < 2**52 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, sha(f"3:{kept[j][0]}"), kept[j][1]))
    centres = [kept[j][1] for j in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    place = lambda: [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in kept]
    for _ in range(rounds):
        at = place()
        for c in range(len(centres)):
            mine = [kept[i][1] for i in range(len(kept)) if at[i] == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = place()
    return sorted(((i is None, i or 0), c, min(far(v, centres[c]), 2**63 - 1), sha(",".join(map(str, centres[c])))) for (i, v), c in zip(kept, at, strict=True))


def clusters(df, **options):
    rows = with_inertia(*centroid_clusters(df, **options))
    out = rows.collect()
    for r in out:
        assert r.inertia == min(sum(x.distance for x in out), 2**63 - 1)
        assert r.cluster_inertia == min(sum(x.distance for x in out if x.cluster == r.cluster), 2**63 - 1)
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.centroid_sha256) for r in out)


@pytest.mark.parametrize("scale", [1.0, 3e9, 1e30])
def test_centroids_with_ties_and_odd_rows(spark, scale):
    rng, nan = random.Random(8), float("nan")
    rows = [(i, [scale * rng.choice((-1.0, 0.0, 0.5, 2.0)) for _ in range(3)]) for i in range(60)]
    rows += rows[:5] + [(None, [scale, 0.0, 0.0]), (70, None), (71, [1.0, 2.0]), (72, [1.0, 2.0, nan]), (73, [1.0, None, 2.0]), (74, [float("inf"), 0.0, 0.0]), (75, [-0.0001, 1e-320, 7.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "vector", "cluster", "distance", "hash")})
    assert clusters(df, rounds=3, size=3) == brute_clusters(rows, rounds=3, size=3)


def test_centroids_few_and_none(spark):
    rows = [(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [5.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert clusters(df, size=2) == brute_clusters(rows, size=2)
    assert clusters(df.limit(0), size=2) == [] == clusters(df, size=64)


def test_intervals_hold_the_exact_values():
    """Bounds hold for long, short and nearly equal vectors; rows whose centres are nearly as near are settled exactly."""
    rng = np.random.default_rng(4)
    for size in (1e2, 1e5, 1e9, 1e14):
        x = np.floor(rng.normal(size=(300, 64)) * size).astype(np.int64)
        centres = np.concatenate([x[:4], x[:4] + rng.integers(0, 2, (4, 64))])
        low, high = bounds(x.astype(float), centres.astype(float))
        exact = np.array([[sum(int(b) * int(b) - 2 * int(a) * int(b) for a, b in zip(v, c, strict=True)) for c in centres] for v in x[:40]], object)
        assert all(float(low[i, j]) <= exact[i, j] <= float(high[i, j]) for i in range(40) for j in range(8))
        mid = (x[:4] + x[4:8]) // 2
        both = np.concatenate([x[:4], x[4:8]])
        best, unsure = nearest(np.concatenate([mid, x]), both)
        all_ = [[int(v) for v in squared(np.concatenate([mid, x]), c).tolist()] for c in both]
        assert best.tolist() == [min(range(8), key=lambda c: (all_[c][i], c)) for i in range(len(best))]
        assert len(unsure) < len(best)
    assert whole_numbers(np.array([-0.0001, 0.5, 1e300])).tolist() == [-1, 512, int(1e300) * 1024]


# op13


def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda t: (t[0], t[1], sha(f"{len(t[2].encode())}:{t[2]}{t[3]}"))
    turns = {c: [t[2:] for t in sorted(x, key=key)] for c, x in turns.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + turns[c][h:]
    nodes = defaultdict(list)
    for c, x in whole.items():
        for d in range(len(x) + 1):
            nodes[tuple(x[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in nodes:
        if n:
            kids[n[:-1]] += 1
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(members) - 1) * (len(n[-1][1].encode()) if n else 0)
    return sorted(((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), kids.get(n, 0), leaves[n], saved[n], sha(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(n)))))) for n, m in nodes.items()), key=str)


def trie(df):
    rows = prefix_trie(*rebuilt(df)).collect()
    place = {r.position: r for r in rows}
    assert sorted(place) == list(range(len(rows)))
    for r in rows:  # intervals nest
        inside = [place[p] for p in range(r.position, r.subtree_end + 1)]
        assert sum(x.n_children == 0 for x in inside) == r.n_leaves and all(x.depth > r.depth for x in inside[1:])
    return sorted((tuple(r)[:8] for r in rows), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_trie_of_random_conversations(spark):
    rng = random.Random(21)
    for letters in (2, 3):
        rows = [(c, t, rng.choice(("user", "bot")), rng.choice("aéz"[:letters])) for c in rng.sample(range(-30, 400), 120) for t in range(rng.choice((1, 1, 2, 5, 12)))]
        assert trie(spark.createDataFrame(rows, SCHEMA)) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(5, None, None, None), (5, None, None, None), (5, 1, "user", ""), (None, 1, "user", "x"), (6, 1, None, "né"), (6, None, "a", "b"), (7, 0, "", "t" * 100_000), (13, 0, "z", "short"), (11, 3, "a", "b")]
    rows += [(0, t, "u", str(t % 3)) for t in range(400)] + [(10, t, "u", str(t % 3)) for t in range(400)] + [(c, 0, "hot", "same") for c in range(100, 200)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("c", "depth", "no", "n", "h", "head", "bytes", "p1", "position", "__part")})
    assert trie(df) == brute_trie(rows)
    assert trie(df.limit(0)) == []
    assert trie(df.where("conv_id is null")) == []


def test_prefix_sums_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice((1, 1, 1, 2, rng.randrange(3, 50))), i, rng.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, i int, v long")
    expected, upto = [], defaultdict(int)
    for g, i, v in sorted(rows):
        upto[g] += v
        expected.append((g, i, v, upto[g]))
    assert sorted(map(tuple, prefix_sums(df, ["g"], ["i"], {"s": F.col("v")}).collect())) == expected
    total = 0
    for r in prefix_sums(df, [], ["i"], {"s": F.col("v")}).orderBy("i").collect():
        total += r.v
        assert r.s == total

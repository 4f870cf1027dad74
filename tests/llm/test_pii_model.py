"""The CRF's own part: exact decoding and chances on short lines, and added spans on forms that its table doesn't hold."""

import random
from itertools import product

import numpy as np

from eventweave.llm.pii_crf import Crf, base_spans, crf_spans, plausible


def test_viterbi_and_chances_against_all_label_rows():
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 5):
        crf, k = Crf(), len(Crf.LABELS)
        crf.trans = rng.normal(size=(k, k))
        e = rng.normal(size=(n, 1, k)) * 2
        ways = list(product(range(k), repeat=n))
        value = np.array([sum(e[t, 0, w[t]] for t in range(n)) + sum(crf.trans[w[t], w[t + 1]] for t in range(n - 1)) for w in ways])
        assert tuple(crf.viterbi(e, np.array([n]))[:, 0]) == ways[int(value.argmax())]
        chance = np.exp(value - np.logaddexp.reduce(value))
        one, two = crf.chances(e, np.ones((n, 1), bool))
        for t, g in product(range(n), range(k)):
            assert abs(one[t, 0, g] - sum(c for w, c in zip(ways, chance, strict=True) if w[t] == g)) < 1e-9
            for m in range(k) if t + 1 < n else ():
                assert abs(two[t, 0, g, m] - sum(c for w, c in zip(ways, chance, strict=True) if w[t] == g and w[t + 1] == m)) < 1e-9


def added(line):
    base = base_spans(line)
    return [(line[s:e], k) for s, e, k in crf_spans([line])[0] if plausible(k, line[s:e]) and not any(s < y and x < e for x, y, _ in base)]


def test_added_phones_in_words_that_the_table_does_not_hold():
    """Precision and recall of added spans alone, on made-up numbers in unseen lines; and numbers of other kinds in like lines."""
    rng = random.Random(8)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    forms = [lambda: f"{rng.randrange(200, 999)} {d(3)} {d(4)}", lambda: f"{rng.randrange(200, 999)}-{d(3)}-{d(4)}", lambda: f"0{rng.randrange(20, 99)} {d(8)}", lambda: f"0{rng.randrange(100, 199)}-{d(7)}", lambda: f"{rng.randrange(2, 9)}{d(9)}", lambda: f"({rng.randrange(200, 999)}) {d(3)}-{d(4)}"]
    lines = ["Tel. {} in the evening", "you can call {} about the flat", "her mobile: {}", "Phone {} and leave word", "dial {} for the desk"]
    others = [lambda: f"20{d(2)}-{rng.randrange(10, 13)}-{rng.randrange(10, 28)}", lambda: f"17{d(8)}", lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{rng.randrange(10, 23)}:{rng.randrange(10, 59)}:{rng.randrange(10, 59)}", lambda: f"DE{d(2)} {d(4)} {d(4)} {d(4)}"]
    plain = ["stamped {} by the clerk", "the record {} was lost", "under {} in the book"]
    told = right = wanted = 0
    for _ in range(300):
        value = rng.choice(forms)()
        found = added(rng.choice(lines).format(value))
        wanted, told, right = wanted + 1, told + len(found), right + ((value, "phone") in found)
        found = added(rng.choice(plain).format(rng.choice(others)()))
        told += len(found)
    print("precision", right / told, "recall", right / wanted)
    assert right / told >= 0.9 and right / wanted >= 0.9


def test_lines_that_were_missed_before():
    for line, value in (("phone 202 555 0171 ok", "202 555 0171"), ("call 2025550171", "2025550171"), ("Tel. 030 12345678", "030 12345678"), ("ring 0171-2345678", "0171-2345678")):
        assert added(line) == [(value, "phone")], line
    for line in ("call 3 people in 2024", "phone the 120 people", "at 1700000000 the log", "isbn 978-3-16-148410-0", "ssn 078-05-1120", "order 4471-2281-9034 of 2024"):
        assert added(line) == [], line

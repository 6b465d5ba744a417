"""Interactions of filters against a walk of every order over every document."""

import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from oracle import difference

from quern.llm import audit
from quern.llm import queries as Q
from quern.llm.oracles import SQL


def failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        *("A" if len(words) < 50 else ""),
        *("B" if 100 * len(set(words)) < 65 * len(words) else ""),
        *("C" if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else ""),
        *("D" if re.search("[#$%&*|]", text) else ""),
    }


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = [failures(t or "") | ({"E"} if i is not None and first[t or ""] < i else set()) for i, t, _ in docs]
    rows, total = [], Counter()
    for part in {s or "" for _, _, s in docs}:
        mine = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        for order in permutations("ABCDE"):
            left = set(mine)
            for step, f in enumerate(order, 1):
                hit = {k for k in mine if f in fails[k]}
                out = hit & left
                lost = [sum(docs[k][0] in of for k in out) for of in (good, toxic)]
                redundant = len(hit - left)
                left -= out
                total[part, f] += len(out)
                rows.append([part, "".join(order), step, len(left), len(out), redundant, sum(fails[k] == {f} for k in mine), *lost])
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in rows)


WORDS = [f"w{i}" for i in range(60)]
BODIES = [
    None, "", "SHOUT", "a # b", " ".join(WORDS), " ".join(WORDS), " ".join(WORDS[:30] * 2), " ".join(WORDS[:39] + WORDS[:21]), " ".join(WORDS[:49]),
    " ".join(WORDS[:50]), "ABCDE" + "é" * 95, "ABCDEF" + "é" * 94, "😀" * 20 + "AA", "tie |", "tie |", "Tie |", "x" * 70_000, " ".join(f"L{i % 9000}" for i in range(20_000)),
]


def table(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


def test_against_every_order(spark):
    docs = [(i, t, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(BODIES)] + [(None, "tie |", "s0"), (None, None, "s1"), (2, "SHOUT", "s2"), (2, "SHOUT", "s2"), (1, "SHOUT", None)]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 18, 2)] + [(3, None, 1), (3, 1, 0), (3, 1, 0), (None, 1, 1), (99, 1, 1)]
    made = table(spark, [(*d, "x", 1, 2) for d in docs], "doc_id long, text string, source string, part string, n int, mask int")
    marked = table(spark, [(*x, 5) for x in labels], "doc_id long, quality int, toxic int, n int")
    out = audit.interactions(audit.masks(made, marked))
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, out.collect())) == brute(docs, labels)
    assert not audit.interactions(audit.masks(made.limit(0), marked)).collect()
    none = audit.interactions(audit.masks(made, marked.limit(0))).agg({"good_lost": "max", "toxic_lost": "max"}).first()
    assert tuple(none) == (0, 0)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_polynomials(k):
    rnd = np.random.default_rng(k)
    counts = rnd.integers(0, 50, (4, 1 << k))
    polynomials = audit.coefficients(counts)
    values = audit.corners(polynomials)
    for row, p, v in zip(counts.tolist(), polynomials.tolist(), values.tolist(), strict=True):
        assert v == [sum(c for m, c in enumerate(row) if m & s) for s in range(1 << k)]
        gains = [Fraction(0)] * k
        for order in permutations(range(k)):
            seen = 0
            for f in order:
                gains[f] += v[seen | 1 << f] - v[seen]
                seen |= 1 << f
        assert audit.shapley(p, k) == [g / len(list(permutations(range(k)))) for g in gains]
        # anywhere between the corners: the expected number that random switches remove
        x = [Fraction(i + 1, k + 2) for i in range(k)]
        product = lambda of: np.prod([*of, Fraction(1)])
        assert sum(c * product(x[i] for i in range(k) if s >> i & 1) for s, c in enumerate(p)) == sum(c * (1 - product(1 - x[i] for i in range(k) if m >> i & 1)) for m, c in enumerate(row))


def test_query_against_sql(spark, sf):
    assert difference(Q.op13_shapley(spark, sf), sf, SQL["op13_shapley"]) == ""

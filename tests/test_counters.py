"""Passages by counters that do not add up, against the rule told step by step."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quern.functions.counters import Characters, Pieces
from quern.operators import sections as P


class Odd:
    """Counts by the number of vowels and of code points: cutting may raise or lower it."""

    longest = 9

    def count(self, text):
        return -(-len(text) // 9) + len(re.findall("a[^a]{0,3}$|[aeiou]{2}| {2}", text))


def by_the_rule(body, spans, counter, most, overlap, overhead):
    room, out = most - overhead, []
    for name, a, b in spans:
        units = []
        ends = [m.span() for m in re.finditer(P.SENTENCE_END, body[a:b])]
        for x, y in zip([a] + [a + e for _, e in ends], [a + s for s, _ in ends] + [b]):
            part = body[x:y]
            x, y = x + len(part) - len(part.lstrip()), x + len(part.rstrip())
            if x >= y:
                continue
            n = counter.count(body[x:y])
            if n <= overlap or overlap == 0 and n <= room:
                units.append([x, y, n])
                continue
            held = None
            for m in re.finditer(r"\S+", body[x:y]):
                u, v, k = x + m.start(), x + m.end(), counter.count(m[0])
                if held and held[2] + k > max(overlap, 1):
                    units.append(held)
                    held = None
                held = [held[0], v, held[2] + k] if held else [u, v, k]
            units.append(held)
        i = 0
        while i < len(units):
            j, total = i, 0
            while j < len(units) and total + units[j][2] <= room:
                total += units[j][2]
                j += 1
            j = max(j, i + 1)
            while True:
                x, y = units[i][0], units[j - 1][1]
                n = counter.count(body[x:y]) + overhead
                if n <= most:
                    out.append((len(out), name, x, y, n))
                    break
                if j - i > 1:
                    j -= 1
                    continue
                low, high = 1, y - x
                while low < high:
                    mid = (low + high + 1) // 2
                    if counter.count(body[x : x + mid]) + overhead <= most:
                        low = mid
                    else:
                        high = mid - 1
                units[i : i + 1] = [[x, x + low, counter.count(body[x : x + low])], [x + low, y, counter.count(body[x + low : y])]]
            if j >= len(units):
                break
            step, held = j, 0
            while step - 1 > i and held + units[step - 1][2] <= overlap:
                held += units[step - 1][2]
                step -= 1
            i = step
    return out


@pytest.mark.parametrize("seed", range(40))
def test_against_the_rule(seed):
    rnd = random.Random(seed)
    counter = [Characters(4), Characters(3), Pieces((" de", "tion", "ab-", "a", "  ", "😀é", ". ")), Odd()][seed % 4]
    word = lambda: rnd.choice(["a", "de", "ção", "tion", "x" * 30, "3,14", "ab-" * 70, "😀é" * 20, "tion" * 40])
    body = "".join(" ".join(word() for _ in range(rnd.randrange(1, 20))) + rnd.choice([". ", "; ", "\n", "?  ", ".\n", " "]) for _ in range(25))
    most, overlap, overhead = rnd.choice([(40, 10, 2), (60, 0, 2), (25, 11, 3), (9, 3, 1)])
    cut = sorted(rnd.sample(range(len(body)), 2))
    spans = [("facts", *P._trimmed(body, 0, cut[0])), ("content", *P._trimmed(body, *cut))]
    spans = [s for s in spans if s[1] < s[2]]
    got = P.fitted_passages(body, spans, counter, most, overlap, overhead)
    assert got == by_the_rule(body, spans, counter, most, overlap, overhead)
    assert all(n <= most for *_, n in got)


def test_recounting_drops_units():
    """By separate counts eight sentences fit; with the blanks between them eight tokens hold only six."""
    body = " ".join(["abc."] * 20)
    assert P.fitted_passages(body, [("content", 0, len(body))], Characters(4), 10, 0)[0] == (0, "content", 0, 29, 10)


def test_limits_and_long_words():
    with pytest.raises(ValueError):
        P.fitted_passages("a", [("content", 0, 1)], Characters(), 10, 5)
    body = "y" * 1_000_000
    got = P.fitted_passages(body, [("content", 0, len(body))], Characters(4))
    assert got[0][2] == 0 and got[-1][3] == len(body)
    assert all(p[3] == q[2] for p, q in zip(got, got[1:])) and {g[4] for g in got[:-1]} == {512}


def test_offsets_after_wide_characters(spark):
    rows = [(1, "😀😀 intro\nConteúdo: Assunto\nPEDIDO\nTexto 😀 x\nCONCLUSÃO\nFim."), (2, "é\nCONTEUDO: a b"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    got = [(r["doc_id"], r["section"], texts[r["doc_id"]][r["start"] : r["end"]]) for r in P.section_table(df).orderBy("doc_id", "ordinal").collect()]
    assert got == [(1, "header", "😀😀 intro"), (1, "request", "Assunto"), (1, "request", "PEDIDO\nTexto 😀 x"), (1, "conclusion", "CONCLUSÃO\nFim."), (2, "header", "é"), (2, "content", "a b")]
    for counter in (None, Characters(4)):
        cut = P.chunk_table(df, 20, 4, counter).where(F.col("doc_id") == 1).collect()
        assert all(texts[1][r["start"] : r["end"]] == r["text"] for r in cut) and {r["section"] for r in cut} == {"header", "request", "conclusion"}

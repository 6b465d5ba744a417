"""Repair of conversations against a search over all edits, one conversation at a time."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from quern.llm import conversations as C
from quern.llm import queries as Q

SHAPE = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """Rows (conv_id, turn, role, text) after the damage, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        cell = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{cell(conv)}:{cell(turn)}".encode()) % 20
        role, text = cell(role), cell(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        mine += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def brute(mine):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation."""
    faults, seen = [], set()
    for _, role, text in mine:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(maxsize=None)
    def best(i, shape):
        """(cost, edits, roles as K, u or a) from row i on after rows of these initials ('' / s / ..u / ..a)."""
        want = "a" if shape == "u" else "u"
        found = [(0, "", "")] if i == len(mine) and shape in ("", "a") else []
        nexts = []
        if i < len(mine):
            nexts.append((4, "D", "", i + 1, shape))
            extra = 3 * (faults[i] == "truncated")
            if faults[i] not in ("blank", "duplicate"):
                head = mine[i][1][:1]
                if head == want or head == "s" and shape == "":
                    nexts.append((extra, "K", "K", i + 1, head))
                nexts.append((3 + extra, "R", want, i + 1, want))
        return found, nexts, want

    costs = {}

    def solve():
        states = ("", "s", "u", "a")
        far = (10**9, "", "")
        for i in range(len(mine), -1, -1):
            now = {s: far for s in states}
            for _ in range(6):  # inserts lead from state to state
                for s in states:
                    found, nexts, want = best(i, s)
                    options = list(found)
                    for cost, letter, role, j, to in nexts:
                        c, e, r = costs[j, to]
                        options.append((cost + c, letter + e, role + r if letter != "D" else r))
                    c, e, r = now[want]
                    options.append((3 + c, "I" + e, want.upper() + r))
                    now[s] = min([now[s], *options], key=lambda o: (o[0], o[1]))
            costs.update({(i, s): v for s, v in now.items()})
        return costs[0, ""]

    cost, audit, roles = solve()
    lines, k, row = [], 0, 0
    for letter in audit:
        if letter == "D":
            row += 1
            continue
        role = {"u": "user", "a": "assistant"}.get(roles[k].lower(), None)
        if letter == "I":
            lines.append(f"{role}:")
        else:
            lines.append(f"{mine[row][1] if letter == 'K' else role}:{mine[row][2]}")
            row += 1
        k += 1
    assert SHAPE.fullmatch("".join(x[0] for x in lines))
    turns = [t for t, _, _ in mine if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    heads = [r[1][:1] for r in mine]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(heads, heads[1:]))
    n = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def wild(n=120, seed=1):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "U", "sa"]
    texts = ["One.", "Two!", "three", "", " \n", None, "Four? \t", "é。", "x" * 300 + ".", "😀"]
    rows = []
    for conv in range(n):
        rows += [(conv if conv else None, rnd.choice([t, t, t, t + rnd.randrange(3), None]), rnd.choice(roles), rnd.choice(texts)) for t in range(rnd.randrange(1, 25))]
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"Line {t // 7}.") for t in range(400)]
    rows += [(501, None, "user", "same"), (501, None, "user", "same"), (502, 7, "assistant", "tie."), (502, 7, "assistant", "tie."), (502, 7, "user", "tie.")]
    return rows


@pytest.fixture
def batches(spark):
    """Sets how many rows a Python worker is given at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    yield lambda n: spark.conf.set(name, n)
    spark.conf.set(name, before)


@pytest.mark.parametrize("piece,ranges,batch", [(4096, 16 << 20, 10_000), (3, 16 << 20, 7), (5, 2000, 4), (4096, 3000, 50)])
def test_against_all_edits(spark, monkeypatch, batches, piece, ranges, batch):
    batches(batch)
    monkeypatch.setattr(C, "PIECE_ROWS", piece)
    monkeypatch.setattr(C, "RANGE_BYTES", ranges)
    rows = wild()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, part int")
    want = {conv: brute(mine) for conv, mine in damaged(rows).items()}
    out = C.summaries(C.damage(df))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = out.collect()
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want


def test_repaired_lines_of_pieces(spark, monkeypatch, batches):
    batches(5)
    monkeypatch.setattr(C, "PIECE_ROWS", 4)
    rows = wild(30, 2)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = {}
    for r in C.repair(C.damage(df)).orderBy("piece").collect():
        pieces.setdefault(r.conv_id, []).append(r)
    want = {conv: brute(mine) for conv, mine in damaged(rows).items()}
    assert max(len(p) for p in pieces.values()) > 20
    for conv, p in pieces.items():
        assert [r.piece for r in p] == list(range(p[0].pieces)) == list(range(len(p)))
        text = "\n".join(r.repaired for r in p if r.repaired)
        assert ("".join(r.audit for r in p), hashlib.sha256(text.encode()).hexdigest()) == want[conv][-2:]


def test_query_on_a_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {conv: brute(mine) for conv, mine in damaged(rows).items()}
    assert {r.conv_id: tuple(r)[1:] for r in Q.op11_tensor_repair(spark, sf).collect()} == want


def test_empty_table_and_dropped_rows(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert not C.summaries(C.damage(spark.createDataFrame([], kind))).collect()
    gone = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    (row,) = C.summaries(C.damage(spark.createDataFrame([(9, gone, "user", "Hi.")], kind))).collect()
    assert tuple(row) == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())

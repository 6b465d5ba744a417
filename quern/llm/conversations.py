"""Repair of conversations: the cheapest edits that make roles alternate, by a time-major tensor.

Rows are dealt and sorted by conversation and turn over ranges, so that a task walks whole
conversations in order and a conversation of any length lies in consecutive tasks. A piece
of one (all of it, nearly always) is a column of a tensor (turn, conversation, state):
pieces of like length go backward turn by turn together, every step one numpy operation
over all of them that stores the least cost from each state to the end; then they all walk
forward together, and each takes the least letter whose cost is the stored one.

A conversation in several pieces is joined by what the backward walk of a piece gives from
each state to each other, a small matrix: their products give every piece the costs behind
it, and one walk over its pieces in order carries the state on. No task holds more text
than a few pieces, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import scratch
from quern.llm import memory

#: Rows and bytes of a piece: a conversation up to them is one piece, unless it lies in two ranges.
PIECE_ROWS, PIECE_BYTES = 4096, 4 << 20
#: Bytes of conversations that one range holds, about.
RANGE_BYTES = 16 << 20

#: Costs of the edits.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
FAR = np.int64(1) << 40
#: States: nothing yet, after a system row, after a user row, after an assistant row.
STATES = 4
#: Where an inserted or rerole'd row leads (a user row, but for an assistant row after a user row), and a kept one of each kind.
FOLLOW = np.array([2, 2, 3, 2])
KEEP = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: Costs at the end of a conversation: nothing or an assistant row may end it.
END = np.array([0, FAR, FAR, 0])
#: A row's code: its kind (first letter of its role), what must go, what lacks an end, and rows that only fill the tensor.
SYSTEM, USER, ASSISTANT, ODD = range(4)
MUST_GO, UNENDED, FILL = 4, 8, 16

_LETTERS = np.frombuffer(b"DIKR", np.uint8)


def backward(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least costs (turns + 1, conversations, states) from before each turn to the end, of ``codes``(turns, conversations) and the costs ``ends`` behind them."""
    turns, n = codes.shape
    costs = np.empty((turns + 1, n, STATES), np.int64)

    def with_inserts(c: np.ndarray) -> np.ndarray:
        # Two rounds do: an inserted user row, then an inserted assistant row.
        for _ in range(2):
            c = np.minimum(c, INSERT + c[:, FOLLOW])
        return c

    costs[turns] = with_inserts(ends)
    for t in range(turns - 1, -1, -1):
        after, code = costs[t + 1], codes[t]
        kept = KEEP[code & 3]
        extra = np.where(code & UNENDED, TRUNCATED, 0)[:, None]
        stay = np.where(kept >= 0, np.take_along_axis(after, np.maximum(kept, 0), 1), FAR) + extra
        may_stay = np.where((code & MUST_GO)[:, None] > 0, FAR, np.minimum(stay, REROLE + after[:, FOLLOW] + extra))
        now = with_inserts(np.minimum(np.minimum(DELETE + after, may_stay), FAR))
        costs[t] = np.where((code & FILL)[:, None] > 0, after, now)
    return costs


def trace(codes: np.ndarray, sizes: np.ndarray, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, state before each, state at the end): edits of all conversations, one letter of each at a time; 0 fills.

    Of edits that cost the least the first in the order D, I, K, R is taken; each leads to
    one state only, so that gives the least string. What is ``last`` may still insert
    behind its rows; a piece that goes on leaves that to the next.
    """
    n = codes.shape[1]
    at, state, every = np.zeros(n, np.int64), state.copy(), np.arange(n)
    letters, states = [], []
    while True:
        here = costs[at, every, state]
        live = (at < sizes) | (last & (here > 0))
        if not live.any():
            break
        inside = at < sizes
        turn = np.minimum(at, len(codes) - 1) if len(codes) else at
        code = codes[turn, every] if len(codes) else np.zeros(n, np.int64)
        after = costs[np.minimum(at + 1, len(costs) - 1), every]
        kept = KEEP[code & 3, state]
        extra = np.where(code & UNENDED, TRUNCATED, 0)
        may = inside & (code & MUST_GO == 0)
        letter = np.select(
            [
                inside & (DELETE + after[every, state] == here),
                INSERT + costs[at, every, FOLLOW[state]] == here,
                may & (kept >= 0) & (extra + after[every, np.maximum(kept, 0)] == here),
            ],
            [0, 1, 2],
            3,
        )
        letters.append(np.where(live, _LETTERS[letter], 0))
        states.append(state.copy())
        to = np.select([letter == 0, letter == 2], [state, kept], FOLLOW[state])
        state = np.where(live, to, state)
        at += live & (letter != 1)
    shape = (len(letters), n)
    return np.array(letters, np.uint8).reshape(shape), np.array(states, np.int64).reshape(shape), state


def _buckets(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Which conversations have like lengths: between one power of two and the next."""
    kind = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for k in np.unique(kind):
        yield np.flatnonzero(kind == k)


def _tensor(codes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(turns, conversations), filled up behind shorter ones."""
    turns = int(sizes.max(initial=0))
    at = first[None, :] + np.arange(turns)[:, None]
    inside = np.arange(turns)[:, None] < sizes[None, :]
    return np.where(inside, codes[np.where(inside, at, 0)], FILL) if len(codes) else np.full((turns, len(first)), FILL)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows of ``conversations`` as a fixed hash of ``conv_id:turn`` spoils one in four of them.

    Of crc32 modulo 20: 0 drops the row (kept here, marked), 1 empties its text, 2 removes
    its [.!?], 3 repeats it, 4 sets its role to user. Nulls count as one space.
    """
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        cell("role").alias("role"),
        cell("text").alias("text"),
        (F.crc32(F.encode(F.concat(cell("conv_id"), F.lit(":"), cell("turn")), "UTF-8")) % 20).alias("_kind"),
    )
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    spoilt = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("dropped"), "_kind")
    return spoilt.withColumn("_copy", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with the code that each has by itself."""
    head = F.substr("role", F.lit(1), F.lit(1))
    kind = F.when(head == "s", SYSTEM).when(head == "u", USER).when(head == "a", ASSISTANT).otherwise(ODD)
    last = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", MUST_GO).when(last.isin(".", "!", "?"), 0).otherwise(UNENDED)
    return rows.select("conv_id", "turn", "role", "text", "dropped", (kind + fault).alias("code"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows dealt over ranges and sorted; text takes part in the ranges by its first characters only."""
    key = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn")]
    size = rows.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    dealt = rows.repartitionByRange(max(1, -(-size // RANGE_BYTES)), *key, "role", F.substr("text", F.lit(1), F.lit(32)))
    return dealt.sortWithinPartitions(*key, "role", "text")


_TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_NAMES = [c.split()[0] for c in _TOTALS.split(", ")]
_FOUND = (
    f"conv_id long, part int, seq int, whole boolean, {_TOTALS}, audit string, repaired string, "
    "turns array<long>, roles array<string>, texts array<string>, codes array<int>, keys array<binary>"
)


def _text_keys(table: pa.Table) -> pa.Array:
    """Role and text of each row as one value."""
    size = pc.cast(pc.binary_length(table.column("role")), pa.string())
    return pc.binary_join_element_wise(size, table.column("role"), table.column("text"), ":").combine_chunks()


def _totals(turn: np.ndarray, known: np.ndarray, codes: np.ndarray, seen: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Counts of ``n`` conversations over rows in order, each of the conversation ``owner``; all but gaps may be summed over pieces."""
    count = lambda which: np.bincount(owner[which], minlength=n)
    blank = codes & MUST_GO > 0
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, owner[known], turn[known])
    np.maximum.at(high, owner[known], turn[known])
    fresh = known.copy()
    fresh[1:] &= ~known[:-1] | (turn[1:] != turn[:-1]) | (owner[1:] != owner[:-1])
    kind = codes & 3
    same = owner[1:] == owner[:-1]
    legal = (kind[1:] == USER) & ((kind[:-1] == SYSTEM) | (kind[:-1] == ASSISTANT)) | (kind[1:] == ASSISTANT) & (kind[:-1] == USER)
    return {
        "gaps": np.where(count(known) > 0, high - low + 1 - count(fresh), 0),
        "blank": count(blank),
        "duplicate": count(~blank & seen),
        "truncated": count(~seen & (codes & UNENDED > 0)),
        "illegal": np.bincount(owner[1:][same & ~legal], minlength=n),
    }


def _with_copies(codes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Codes in which a copy must go and has no other fault."""
    return np.where(seen, codes & 3 | MUST_GO, codes)


def _edit(roles: pa.Array, texts: pa.Array, codes: np.ndarray, first: np.ndarray, sizes: np.ndarray, ends: np.ndarray, state: np.ndarray, last: np.ndarray):
    """(cost, audit, repaired text, state at the end) of pieces that lie one after another in rows."""
    n_rows = len(codes)
    roles = pa.concat_arrays([roles, pa.array(["user", "assistant"])])
    texts = pa.concat_arrays([texts, pa.array([""])])
    order, cost, left, audits, repaired = [], [], [], [], []
    for which in _buckets(sizes):
        tensor = _tensor(codes, first[which], sizes[which])
        costs = backward(tensor, ends[which])
        letters, states, end = trace(tensor, sizes[which], costs, state[which], last[which])
        order.append(which)
        cost.append(costs[0, np.arange(len(which)), state[which]])
        left.append(end)
        own, step = np.nonzero(letters.T)  # each piece's letters in order
        letter, before = letters[step, own], states[step, own]
        audits.append(_strings(letter.tobytes(), np.bincount(own, minlength=len(which))))
        used = letter != ord("I")
        taken = np.cumsum(used) - used
        start = np.searchsorted(own, np.arange(len(which)))
        row = first[which][own] + taken - (np.append(taken, 0)[start])[own] if len(own) else np.zeros(0, np.int64)
        stays = letter != ord("D")
        own, letter, row, before = own[stays], letter[stays], row[stays], before[stays]
        role = roles.take(pa.array(np.where(letter == ord("K"), row, n_rows + (FOLLOW[before] == 3))))
        text = texts.take(pa.array(np.where(letter == ord("I"), n_rows, row)))
        lines = pc.binary_join_element_wise(role, text, ":")
        at = np.append(0, np.cumsum(np.bincount(own, minlength=len(which))))
        repaired.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), lines), "\n"))
    back = np.argsort(np.concatenate([*order, np.zeros(0, int)]))
    join = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)])[back]
    strings = lambda parts: pa.concat_arrays([*parts, pa.array([], pa.string())]).take(pa.array(back))
    return join(cost, np.int64), strings(audits), strings(repaired), join(left, np.int64)


def _strings(raw: bytes, sizes: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw))


def _starts(ids: pa.ChunkedArray) -> np.ndarray:
    """First row of each run of equal ids; null is an id."""
    known = ids.is_valid().to_numpy()
    value = ids.fill_null(0).to_numpy()
    return np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (known[1:] != known[:-1])))[: len(value)]


def _finder():
    @memory.tidy
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: pa.Table | None = None
        opens = True  # the first conversation of a range may have begun in the one before
        cut = False  # a piece of the held conversation has gone already

        def pieces(table: pa.Table, first: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
            nonlocal seq
            out = _found(table, first, whole, part, seq)
            seq += len(first)
            return out

        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            first = _starts(held.column("conv_id"))
            done = int(first[-1]) if len(first) else 0
            if done:
                whole = np.ones(len(first) - 1, bool)
                whole[0] = not (opens or cut)
                yield pieces(held.slice(0, done), first[:-1], whole)
                held, opens, cut = held.slice(done), False, False
            if held.num_rows > PIECE_ROWS or held.nbytes > PIECE_BYTES:
                step = max(1, min(PIECE_ROWS, held.num_rows * PIECE_BYTES // max(held.nbytes, 1)))
                at = np.arange(0, held.num_rows, step)
                yield pieces(held, at, np.zeros(len(at), bool))
                held, cut = held.slice(held.num_rows), True
        if held is not None and held.num_rows:
            yield pieces(held, np.zeros(1, int), np.zeros(1, bool))

    return find


def _found(table: pa.Table, first: np.ndarray, whole: np.ndarray, part: int, seq: int) -> pa.RecordBatch:
    """Whole conversations repaired, and the rows of other pieces, as rows of _FOUND."""
    n = len(first)
    ids = table.column("conv_id").combine_chunks().take(pa.array(first))
    gone = table.column("dropped").to_numpy()
    owner = np.repeat(np.arange(n), np.diff(np.append(first, table.num_rows)))[~gone]
    table = table.filter(pa.array(~gone))
    first = np.searchsorted(owner, np.arange(n))
    sizes = np.diff(np.append(first, len(owner)))
    roles, texts = (table.column(c).combine_chunks() for c in ("role", "text"))
    keys = _text_keys(table)
    named = keys.dictionary_encode()
    named = (named if isinstance(named, pa.DictionaryArray) else named.combine_chunks()).indices.to_numpy().astype(np.int64)
    seen = np.ones(len(owner), bool)
    seen[np.unique(owner * (len(owner) + 1) + named, return_index=True)[1]] = False
    known = table.column("turn").is_valid().to_numpy()
    turn = table.column("turn").fill_null(0).to_numpy()
    codes = table.column("code").to_numpy().astype(np.int64)
    totals = _totals(turn, known, codes, seen, owner, n)
    alone = np.flatnonzero(whole)
    cost, audit, repaired, _ = _edit(roles, texts, _with_copies(codes, seen), first[alone], sizes[alone], np.tile(END, (len(alone), 1)), np.zeros(len(alone), int), np.ones(len(alone), bool))
    totals["cost"] = np.zeros(n, np.int64)
    totals["cost"][alone] = cost
    place = np.full(n, -1)
    place[alone] = np.arange(len(alone))
    place = pa.array(place, mask=place < 0)
    # The rows themselves only of pieces that are not whole.
    loose = np.flatnonzero(~whole[owner])
    lengths = np.where(whole, 0, sizes)
    at = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
    rows = pa.array(loose)
    digests = pa.array([hashlib.sha256(k.encode()).digest() for k in keys.take(rows).to_pylist()], pa.binary())
    values = {
        "turns": table.column("turn").combine_chunks().take(rows),
        "roles": roles.take(rows),
        "texts": texts.take(rows),
        "codes": pa.array(codes[loose], pa.int32()),
        "keys": digests,
    }
    columns = {"conv_id": ids, "part": pa.array(np.full(n, part), pa.int32()), "seq": pa.array(seq + np.arange(n), pa.int32()), "whole": pa.array(whole)}
    columns |= {c: pa.array(totals[c], pa.int64()) for c in _NAMES}
    columns |= {"audit": audit.take(place), "repaired": repaired.take(place)}
    columns |= {c: pa.ListArray.from_arrays(at, v) for c, v in values.items()}
    return pa.RecordBatch.from_pydict(columns)


_PIECE = f"part int, seq int, piece int, pieces int, {_TOTALS}, ends array<long>"
_MATRIX = "conv_id long, part int, seq int, n int, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, head int, tail int, matrix array<long>"


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What joins each piece to those beside it: its counts, its ends, and the least cost from each state to each other."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            codes, seen = np.array(r["codes"], np.int64), np.zeros(len(r["codes"]), bool)
            seen[r["copies"] or []] = True
            known = np.array([t is not None for t in r["turns"]], bool)
            turn = np.array([t or 0 for t in r["turns"]], np.int64)
            totals = _totals(turn, known, codes, seen, np.zeros(len(codes), int), 1)
            tensor = np.repeat(_with_copies(codes, seen)[:, None], STATES, 1)  # one conversation for each state at its end
            matrix = backward(tensor, np.where(np.eye(STATES, dtype=bool), 0, FAR))[0].T
            few = np.unique(turn[known])
            low, high = (int(few[0]), int(few[-1])) if len(few) else (None, None)
            kind = (codes & 3).tolist() or [None]
            counts = {c: int(totals[c][0]) for c in ("blank", "duplicate", "truncated", "illegal")}
            rows.append({c: r[c] for c in ("conv_id", "part", "seq")} | {"n": len(codes), "low": low, "high": high, "turns": len(few), **counts, "head": kind[0], "tail": kind[-1], "matrix": matrix.reshape(-1).tolist()})
        yield pa.RecordBatch.from_pylist(rows, _arrow(_MATRIX))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _joined(table: pa.Table) -> pa.Table:
    """A conversation's pieces, each with the totals of all and the costs behind it."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    behind, ends = END, []
    for r in reversed(rows):
        ends.append(behind)
        behind = np.minimum((np.array(r["matrix"]).reshape(STATES, STATES) + behind[None, :]).min(axis=1), FAR)
    totals = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
    full = [r for r in rows if r["n"]]
    legal = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
    totals["illegal"] += sum((x["tail"], y["head"]) not in legal for x, y in zip(full, full[1:], strict=False))
    dated = [r for r in rows if r["turns"]]
    distinct = sum(r["turns"] for r in dated) - sum(x["high"] == y["low"] for x, y in zip(dated, dated[1:], strict=False))
    totals["gaps"] = dated[-1]["high"] - dated[0]["low"] + 1 - distinct if dated else 0
    totals["cost"] = int(behind[0])
    out = [{"part": r["part"], "seq": r["seq"], "piece": k, "pieces": len(rows), **totals, "ends": e.tolist()} for k, (r, e) in enumerate(zip(rows, reversed(ends), strict=True))]
    return pa.Table.from_pylist(out, _arrow(_PIECE))


_REPAIRED = f"conv_id long, piece int, pieces int, {_TOTALS}, audit string, repaired string"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of pieces that come in order, the state carried from each to the next of its conversation."""
    state = np.zeros(1, int)
    for batch in batches:
        for r in batch.to_pylist():
            if r["piece"] == 0:
                state = np.zeros(1, int)
            codes, seen = np.array(r["codes"], np.int64), np.zeros(len(r["codes"]), bool)
            seen[r["copies"] or []] = True
            rows = (pa.array(r[c], pa.string()) for c in ("roles", "texts"))
            last = np.array([r["piece"] == r["pieces"] - 1])
            _, audit, repaired, state = _edit(*rows, _with_copies(codes, seen), np.zeros(1, int), np.array([len(codes)]), np.array([r["ends"]]), state, last)
            made = {c: r[c] for c in ("conv_id", "piece", "pieces", *_NAMES)} | {"audit": audit[0].as_py(), "repaired": repaired[0].as_py()}
            yield pa.RecordBatch.from_pylist([made], _arrow(_REPAIRED))


def _found_pieces(rows: DataFrame) -> DataFrame:
    return scratch.save(_ordered(_marked(rows)).mapInArrow(_finder(), _FOUND), "conversations")


def _whole(found: DataFrame) -> DataFrame:
    return found.where("whole").select("conv_id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), *_NAMES, "audit", "repaired")


def _cut(found: DataFrame) -> DataFrame:
    """Conversations that lie in two ranges or are longer than a piece, as pieces in order."""
    loose = found.where("NOT whole").select("conv_id", "part", "seq", "turns", "roles", "texts", "codes", "keys")
    # A copy is a row whose role and text an earlier row of its conversation has: all but the least place of each.
    place = loose.select("conv_id", "part", "seq", F.posexplode("keys").alias("at", "key"))
    spot = F.struct("part", "seq", "at")
    least = place.groupBy("conv_id", "key").agg(F.min(spot).alias("s")).select("s.*")
    copies = place.join(least, ["part", "seq", "at"], "left_anti").groupBy("part", "seq").agg(F.sort_array(F.collect_list("at")).alias("copies"))
    ready = loose.drop("keys").join(copies, ["part", "seq"], "left")
    narrow = scratch.save(ready.select("conv_id", "part", "seq", "turns", "codes", "copies").mapInArrow(_matrices, _MATRIX), "matrices")
    known = narrow.groupBy("conv_id").applyInArrow(_joined, _PIECE)
    walked = ready.join(known, ["part", "seq"]).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return walked.select("conv_id", "piece", "pieces", *_NAMES, "ends", "roles", "texts", "codes", "copies").mapInArrow(_walk, _REPAIRED)


def repair(rows: DataFrame) -> DataFrame:
    """Repaired conversations of ``rows``(conv_id, turn, role, text, dropped), in pieces.

    conv_id, piece (from 0), pieces; gaps, blank, duplicate, truncated, illegal, cost of the
    whole conversation, repeated on each piece; audit and repaired (lines ``role:text``) of
    the piece. Nearly every conversation is one piece. Rows go by turn (null first), then
    role, then text; rows marked dropped only say that their conversation exists, and one
    without other rows has zeros and empty strings. A null conv_id is a conversation too.
    Roles and texts are not null (``damage`` sees to that). An empty table gives no rows.
    """
    found = _found_pieces(rows)
    return _whole(found).unionByName(_cut(found))


_SUMMARY = f"conv_id long, {_TOTALS}, audit string, repaired_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation whose pieces come in order; its text passes through the hash and is not kept."""
    for batch in batches:
        for r in batch.to_pylist():
            if r["piece"] == 0:
                digest, audit, lines = hashlib.sha256(), [], False
            if r["repaired"]:
                digest.update(b"\n" * lines + r["repaired"].encode())
                lines = True
            audit.append(r["audit"])
            if r["piece"] == r["pieces"] - 1:
                made = {c: r[c] for c in ("conv_id", *_NAMES)} | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
                yield pa.RecordBatch.from_pylist([made], _arrow(_SUMMARY))


def summaries(rows: DataFrame) -> DataFrame:
    """``repair`` with one row for each conversation: its totals, its edits and the SHA-256 of its repaired lines."""
    found = _found_pieces(rows)
    whole = _whole(found).select("conv_id", *_NAMES, "audit", F.sha2("repaired", 256).alias("repaired_sha256"))
    cut = _cut(found).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return whole.unionByName(cut.mapInArrow(_digests, _SUMMARY))

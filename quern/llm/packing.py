"""Minimum bin slack: full sequences by bitset subset sums over the lengths that are left.

A sequence is decided by lengths alone, and there are at most ``capacity`` of them, so the
plan is made from the histogram of lengths: the longest length left opens a sequence, a
subset-sum over a bitset of reachable sums (one bounded dynamic programme over the
available lengths) finds the fullest feasible rest, and that combination is removed as many
times as the counts allow. The plan grows with the number of lengths, not of documents.
Every piece then finds its place by its rank among the pieces of its length; ranks are
numbered in two levels, so a length that a third of all pieces share is no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern import scratch
from quern.llm import memory, tokens, words

CAPACITY = 2048
#: The id that ends a document.
END = 0
#: Pieces of a length that one task numbers, about.
BLOCK_ROWS = 5_000

_PIECES = "doc_id long, piece int, start long, length long, ids binary"


def _cutter(vocabulary: str, capacity: int):
    @memory.tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).many
        for batch in batches:
            data, offsets = words.buffers(batch.column("text"))
            for i, j in words.chunks(offsets, tokens.CHUNK):
                ids, at = encode(data, offsets[i : j + 1])
                size = np.diff(at) + 1  # with the end
                full = np.zeros(size.sum(), "<u4")
                stop = np.cumsum(size)
                inner = np.ones(len(full), bool)
                inner[stop - 1] = False
                full[inner] = ids
                full[~inner] = END
                n = -(-size // capacity)
                row = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = size - (n - 1) * capacity  # the first piece may be shorter
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                begin = (stop - size)[row] + start
                raw = full.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i).take(pa.array(row)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)], pa.binary()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return cut


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of whole texts.

    A document's ids end with END; one longer than ``capacity`` is cut, its first piece
    taking the rest. Null text counts as empty, so it is one piece of one id. Rows that
    repeat a doc_id are pieces of their own; a null doc_id stays null.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_cutter(vocabulary, capacity), _PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The lengths, with how many of each, whose sum is the largest up to ``room``."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            after = reach | (reach << (length * k)) & mask
            if after != reach:
                steps.append((length, k, reach))
                reach = after
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + k
            total -= length * k
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many sequences each fills, until no piece is left."""
    left, out = {length: n for length, n in counts.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = {length: n for length, n in left.items() if n and length <= capacity - longest}
        use = fullest(rest, capacity - longest) if rest else {}
        left[longest] += 1
        use[longest] = use.get(longest, 0) + 1
        times = min(left[length] // k for length, k in use.items())
        out.append((use, times))
        for length, k in use.items():
            left[length] -= k * times
            if not left[length]:
                del left[length]
    return out


def _table(combinations: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, how many in a sequence, offset in it)."""
    rows, ranks, sequence = {}, {}, 0
    for use, times in combinations:
        at = 0
        for length in sorted(use, reverse=True):
            k = use[length]
            rows.setdefault(length, []).append((ranks.get(length, 0), sequence, k, at))
            ranks[length] = ranks.get(length, 0) + k * times
            at += length * k
        sequence += times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def _placer(combinations: list[tuple[dict[int, int], int]]):
    table = _table(combinations)

    @memory.tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            order = np.argsort(length, kind="stable")
            values, first = np.unique(length[order], return_index=True)
            for value, at in zip(values.tolist(), np.split(order, first[1:]), strict=True):
                rows = table[value]
                own = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                step = rank[at] - own[:, 0]
                sequence[at] = own[:, 1] + step // own[:, 2]
                offset[at] = own[:, 3] + step % own[:, 2] * value
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return place


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``lengths`` (doc_id, piece, length and more, 1 <= length <= capacity) with sequence_id and offset.

    ``lengths`` is read three times: give a written table. Sequences are numbered from 0
    and filled without gaps from offset 0. No rows: no sequences.
    """
    counts = {r["length"]: r["n"] for r in lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    blocks = max(1, -(-sum(counts.values()) // BLOCK_ROWS))
    spread = lengths.withColumn("_block", F.pmod(F.xxhash64(*lengths.columns), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_block").orderBy(*lengths.columns)
    ranked = spread.withColumn("_at", F.row_number().over(within) - 1).join(offsets, ["length", "_block"])
    ranked = ranked.select(*lengths.columns, (F.col("_before") + F.col("_at")).cast("long").alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lengths.schema)
    return ranked.mapInArrow(_placer(plan(counts, capacity)), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``.

    Texts are encoded once; only the pieces' sizes and checksums are kept for packing. An
    empty table gives no rows.
    """
    cut = pieces(docs, vocabulary, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(scratch.save(cut, "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, each at most one capacity long.

    ``placed`` are pieces that went through :func:`pack` with their ids; a piece is told by
    its place, so repeated and null doc_ids are pieces like others.
    """
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))

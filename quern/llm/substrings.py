"""Repeated passages: a count-min prefilter, then exact grouping of what it lets through.

Windows of 13 words are counted in a count-min sketch whose rows are cut into slices of
2**22 cells. Every block of documents (a hash of id and text; its size is a parameter, so there
are as many blocks as the text needs) sends each slice the sorted places it touched, ten
bits or so a window and row; the slice merges the blocks and sends each block back the places
whose merged count is two or more. The estimate never falls short, so a window whose every
place came back covers all repeated windows. Only those are grouped exactly, by 96 bits (two
independent hashes of the words' bytes), once per block; a block then gets the first document of each window that it shares. No sketch,
bitmap or window list is broadcast or collected; what a task holds follows the block and
slice sizes, not the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import memory, words

WINDOW = 13
#: Cells of a slice as a power of two, rows of the sketch, cells a window in a row.
SLICE_BITS, ROWS, CELLS = 22, 2, 4
#: Bytes of text in a block, at least and at most: the text's 512th part between them.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 4 << 20, 16 << 20, 512

_U = np.uint64
_MAX, _MIN = np.iinfo(np.int64).max, np.iinfo(np.int64).min
_SLICE = "row int, slice int, block int, places binary"
#: Windows of a block, packed: two hashes (64 and 32 bits), smallest doc_id, whether others of the block hold it.
_FOUND = "part int, block int, h1 binary, h2 binary, low binary, many binary"
_PACKED = ("h1", "<u8"), ("h2", "<u4"), ("low", "<i8"), ("many", "u1")
_OUT = "doc_id long, n_words long, n_removed long, kept_text string, new_text string"


def _documents(table: pa.Table):
    """Chunks of (first row, past the last row, their words)."""
    data, offsets = words.buffers(table.column("text"))
    for i, j in words.chunks(offsets):
        yield i, j, words.split(data, offsets[i : j + 1])


def _places(h: np.ndarray, row: int, slices: int, bits: int) -> np.ndarray:
    """Cell of each window in a row: slice above, place in it below."""
    x = words.mix(h + _U((row + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return ((x >> _U(32)) % _U(slices) << _U(bits)) | (x & _U((1 << bits) - 1))


def _pack(places: np.ndarray) -> bytes:
    """Sorted places as Rice codes of their gaps: quotients in unary, then remainders of as many bits as the mean gap asks for."""
    n = len(places)
    gaps = np.diff(places, prepend=0)
    bits = max(0, int(0.69 * (int(places[-1]) / n if n else 0)).bit_length() - 1)
    ends = np.cumsum((gaps >> bits) + 1)
    unary = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    unary[ends - 1] = 1
    rest = (gaps[:, None] >> np.arange(bits)).astype(np.uint8) & 1
    return np.array([n, bits], "<u4").tobytes() + np.packbits(rest).tobytes() + np.packbits(unary).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    n, bits = np.frombuffer(raw, "<u4", 2).tolist()
    body = np.frombuffer(raw, np.uint8, offset=8)
    size = -(-n * bits // 8)
    rest = np.unpackbits(body[:size], count=n * bits).reshape(n, bits) @ (1 << np.arange(bits)) if bits else 0
    ends = np.flatnonzero(np.unpackbits(body[size:]))
    return np.cumsum((np.diff(ends, prepend=-1) - 1 << bits) + rest)


def _sketcher(window: int, slices: int, rows: int, bits: int):
    @memory.tidy_group
    def sketch(table: pa.Table) -> pa.Table:
        h = [words.grams(w, window)[0] for _, _, w in _documents(table)]
        h = np.concatenate(h) if h else np.zeros(0, _U)
        block = table.column("block")[0].as_py()
        out = ([], [], [])
        for row in range(rows):
            cells = np.sort(_places(h, row, slices, bits))
            owner = (cells >> _U(bits)).astype(np.int64)
            cut = np.flatnonzero(np.diff(owner, prepend=-1))
            for a, b in zip(cut, np.append(cut[1:], len(cells))[: len(cut)], strict=True):
                out[0].append(row)
                out[1].append(int(owner[a]))
                out[2].append(_pack((cells[a:b] & _U((1 << bits) - 1)).astype(np.int64)))
        n = len(out[0])
        return pa.table({"row": pa.array(out[0], pa.int32()), "slice": pa.array(out[1], pa.int32()), "block": pa.array([block] * n, pa.int32()), "places": pa.array(out[2], pa.binary())})

    return sketch


def _merger(bits: int):
    @memory.tidy_group
    def merge(table: pa.Table) -> pa.Table:
        """Add the blocks' places of one slice; give each block its places that count two or more."""
        total = np.zeros(1 << bits, np.uint8)
        for raw in table.column("places"):
            at, n = np.unique(_unpack(raw.as_py()), return_counts=True)
            total[at] = np.minimum(total[at] + np.minimum(n, 2), 2)
        back = []
        for raw in table.column("places"):
            at = np.unique(_unpack(raw.as_py()))
            back.append(_pack(at[total[at] > 1]))
        return table.set_column(table.schema.get_field_index("places"), "places", pa.array(back, pa.binary()))

    return merge


def _ids(table: pa.Table, missing: int) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(missing).to_numpy()


def _finder(window: int, slices: int, rows: int, bits: int, parts: int):
    @memory.tidy_pair
    def find(docs: pa.Table, flags: pa.Table) -> pa.Table:
        """Windows of a block that every row of the sketch holds repeated, once each."""
        known = [[] for _ in range(rows)]
        for row, slice_, raw in zip(flags.column("row").to_pylist(), flags.column("slice").to_pylist(), flags.column("places"), strict=True):
            known[row].append(_unpack(raw.as_py()) | (slice_ << bits))
        known = [np.sort(np.concatenate(k)).astype(_U) if k else np.zeros(0, _U) for k in known]
        first, last = _ids(docs, _MAX), _ids(docs, _MIN)
        got = []
        for i, _, w in _documents(docs) if docs.num_rows and all(len(k) for k in known) else ():
            h, at = words.grams(w, window)
            keep = np.ones(len(h), bool)
            for row in range(rows):
                x = _places(h, row, slices, bits)
                k = np.searchsorted(known[row], x)
                k[k == len(known[row])] = 0
                keep &= known[row][k] == x
            doc = w.doc[at[keep]] + i
            got.append((h[keep], _second(w, window)[keep], first[doc], last[doc]))
        h1, h2, low, high = map(np.concatenate, zip(*got, strict=True)) if got else (np.zeros(0, _U), np.zeros(0, np.uint32), *(np.zeros(0, np.int64),) * 2)
        part = (h1 >> _U(20)) % _U(parts)
        order, cut = _runs(part, h1, h2)
        low, high = (f.reduceat(x[order], cut) if len(cut) else x for f, x in ((np.minimum, low), (np.maximum, high)))
        pick = order[cut]
        return _rows(part[pick].astype(np.int64), docs.column("block")[0].as_py() if docs.num_rows else 0, h1[pick], h2[pick], low, (low < high).astype(np.uint8))

    return find


def _second(w: words.Words, window: int) -> np.ndarray:
    return words.grams(w, window, seed=1)[0].astype(np.uint32)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order by the keys, where each run of equal keys begins in it)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def _rows(group: np.ndarray, block: int | np.ndarray, *packed: np.ndarray) -> pa.Table:
    """Rows of found windows: one for each run of ``group``, a part or with ``block`` given as array a block."""
    cut = np.flatnonzero(np.diff(group, prepend=-1))
    ends = np.append(cut[1:], len(group))[: len(cut)].tolist()
    data = [[x[a:b].astype(t).tobytes() for a, b in zip(cut.tolist(), ends, strict=True)] for x, (_, t) in zip(packed, _PACKED, strict=True)]
    blocks = [block] * len(cut) if isinstance(block, int) else block[cut]
    return pa.table([pa.array(group[cut].astype(np.int32)), pa.array(blocks, pa.int32()), *(pa.array(d, pa.binary()) for d in data)], ["part", "block", *(n for n, _ in _PACKED)])


def _unrows(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(n).to_pylist()), t) for n, t in _PACKED]


@memory.tidy_group
def _least(table: pa.Table) -> pa.Table:
    """Group the windows of a part over all blocks; give each block those that it does not hold first or alone."""
    h1, h2, low, many = _unrows(table)
    size = [len(x.as_py()) // 8 for x in table.column("h1")]
    block = np.repeat(table.column("block").to_numpy(), size)
    order, cut = _runs(h1, h2)
    least = np.repeat(np.minimum.reduceat(low[order], cut), np.diff([*cut, len(order)])) if len(cut) else low
    back = order[(least < low[order]) | (many[order] > 0)]
    at = np.empty(len(order), np.int64)
    at[order] = least
    back = back[np.argsort(block[back], kind="stable")]
    return _rows(block[back].astype(np.int64), block[back], h1[back], h2[back], at[back], many[back])


def kept_bytes(w: words.Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words joined by one space, and where each document's begin in the result."""
    n_docs = len(w.first) - 1
    s, e, doc = w.starts[keep], w.ends[keep], w.doc[keep]
    more = np.r_[doc[1:] == doc[:-1], False][: len(doc)]
    mark = np.zeros(len(w.data) + 2, np.int8)
    np.add.at(mark, s, 1)
    np.add.at(mark, e + more, -1)
    held = np.cumsum(mark[: len(w.data)], dtype=np.int8) > 0
    text = w.data.copy()
    text[e[more]] = 32
    size = np.bincount(doc, e - s + more, n_docs).astype(np.int64)
    return text[held].tobytes(), np.r_[0, np.cumsum(size)]


def _remover(window: int, carry: tuple[str, ...] = ()):
    @memory.tidy_pair
    def remove(docs: pa.Table, seen: pa.Table) -> pa.Table:
        """Drop the words that a window of an earlier document covers."""
        h1, h2, low, _ = _unrows(seen)
        order = np.argsort(h1, kind="stable")
        h1, h2, low = h1[order], h2[order], low[order]
        ids, out = _ids(docs, _MIN), []
        for i, j, w in _documents(docs):
            n = len(w.hashes)
            gone = np.zeros(n, bool)
            if len(h1):
                a, at = words.grams(w, window)
                b = _second(w, window)
                mine = ids[w.doc[at] + i]
                hit = np.zeros(len(a), bool)
                k = np.searchsorted(h1, a)
                while True:  # equal first halves lie side by side
                    same = (k < len(h1)) & (h1[np.minimum(k, len(h1) - 1)] == a)
                    if not same.any():
                        break
                    c = np.minimum(k, len(h1) - 1)
                    hit |= same & (h2[c] == b) & (low[c] < mine)
                    k = np.where(same, k + 1, len(h1))
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, at[hit], 1)
                np.add.at(edge, at[hit] + window, -1)
                gone = np.cumsum(edge[:n]) > 0
            text, cut = kept_bytes(w, ~gone)
            total = np.r_[0, np.cumsum(gone)]
            removed = total[w.first[1:]] - total[w.first[:-1]]
            kept = pa.StringArray.from_buffers(j - i, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(text))
            whole = docs.column("text").slice(i, j - i).combine_chunks()
            columns = {"doc_id": docs.column("doc_id").slice(i, j - i).combine_chunks(), "n_words": np.diff(w.first), "n_removed": removed, "kept_text": kept, "new_text": pc.if_else(pa.array(removed > 0), kept.cast(whole.type), whole)}
            out.append(pa.table(columns | {c: docs.column(c).slice(i, j - i).combine_chunks() for c in carry}))
        if not out:  # flags without documents cannot be
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string()), "new_text": pa.array([], pa.string())} | {c: docs.column(c) for c in carry})
        return pa.concat_tables(out)

    return remove


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int | None = None, slice_bits: int = SLICE_BITS, rows: int = ROWS, cells: int = CELLS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and new_text of every row, and the columns ``carry``.

    A word goes if a run of ``window`` words that covers it also starts in a document with
    a smaller doc_id; runs are judged on the input. Null or blank text: no words, empty
    kept text. A null doc_id neither removes nor loses words. Rows with equal doc_id do
    not remove each other's words. Documents shorter than the window stay whole.
    ``kept_text`` joins the kept words by one space; ``new_text`` is the text as it was
    where nothing went. An empty table gives no rows.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bytes = block_bytes or min(MOST_BLOCK, max(LEAST_BLOCK, total // BLOCKS))
    blocks = max(1, -(-total // block_bytes))
    slices = max(1, -(-total * cells // (6 << slice_bits)))  # a word takes six bytes about
    parts = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *carry)
    grouped = parts.groupBy("block")
    sketch = grouped.applyInArrow(_sketcher(window, slices, rows, slice_bits), _SLICE)
    flags = sketch.groupBy("row", "slice").applyInArrow(_merger(slice_bits), _SLICE)
    found = grouped.cogroup(flags.groupBy("block")).applyInArrow(_finder(window, slices, rows, slice_bits, blocks), _FOUND)
    # A window has one entry per block, however many documents of the block hold it.
    seen = found.groupBy("part").applyInArrow(_least, _FOUND)
    return grouped.cogroup(seen.groupBy("block")).applyInArrow(_remover(window, carry), _OUT + "".join(f", `{c}` {parts.schema[c].dataType.simpleString()}" for c in carry))

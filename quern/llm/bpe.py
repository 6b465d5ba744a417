"""Byte-level BPE by forced boundaries: ids of whole text columns, and texts of ids.

A merge joins two neighbours into one token of the vocabulary, so two bytes that stand side
by side in no token are never joined, whatever surrounds them: between such a pair lies a
certain cut. The library also splits a text into pre-tokens before it merges; their edges
are found from the classes of code points. Between two cuts lies a fragment that nothing
outside it can change. Distinct fragments of a chunk of text are merged once, all of them
side by side in numpy, and the ids of a text are those of its fragments in order.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from quern.llm import memory, words

#: Bytes of text that are encoded together; a longer text is cut before a blank that precedes a visible character.
CHUNK = 1 << 20
#: Bytes of a fragment up to which it is merged beside others; a longer one is merged by a heap.
LONG = 256

_NONE = np.iinfo(np.int32).max
_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = range(5)
#: What may follow an apostrophe as a pre-token of its own, by first letter.
_SHORT = {"s": "", "t": "", "m": "", "d": "", "r": "e", "v": "e", "l": "l"}


class CodePoints:
    """Classes of code points as the library's pre-tokenizer has them, asked once for each that occurs."""

    def __init__(self) -> None:
        self.known = np.full(0x110000, _UNKNOWN, np.uint8)
        self.known[0xD800:0xE000] = _OTHER
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)

    def of(self, points: np.ndarray) -> np.ndarray:
        found = self.known[points]
        if (found == _UNKNOWN).any():
            new = np.unique(points[found == _UNKNOWN])
            # A code point joins what stands before it exactly if both are of one class.
            probe = "".join(f"\na{c}\n1{c}\n#{c}" for c in map(chr, new.tolist()))
            ends = {a: b for _, (a, b) in self.splitter.pre_tokenize_str(probe)}
            for k, point in enumerate(new.tolist()):
                joined = [ends.get(9 * k + 3 * j + 1) == 9 * k + 3 * j + 3 for j in range(3)]
                self.known[point] = (_LETTER, _NUMBER, _OTHER)[joined.index(True)] if any(joined) else _SPACE
            found = self.known[points]
        return found


@lru_cache(maxsize=1)
def _classes() -> CodePoints:
    return CodePoints()


def pretokens(b: np.ndarray, raw: bytes, edge: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens begin; ``edge`` marks offsets where a text begins or ends.

    A run of letters, of numbers or of other characters takes a blank before it along; of
    white space before such a run the last character is left to it or stands alone; an
    apostrophe with one of seven endings stands for itself.
    """
    points = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
    at = np.flatnonzero((b & 0xC0) != 0x80)
    n = len(points)
    if not n:
        return at
    kind, fresh = _classes().of(points), edge[at]
    before = np.append(_UNKNOWN, kind[:-1])
    before[fresh] = _UNKNOWN  # nothing
    begins = kind != before
    blank = np.append(False, points[:-1] == 32) & ~fresh
    after = np.flatnonzero(begins & (kind != _SPACE) & (before == _SPACE))
    starts = begins | fresh
    starts[after - 1] = True
    starts[after[blank[after]]] = False
    lone = np.flatnonzero((points == 39) & begins & ~blank)
    lone = lone[lone + 1 < n]
    lone = lone[(kind[lone + 1] == _LETTER) & ~fresh[lone + 1]]
    for first, second in _SHORT.items():
        hit = lone[points[lone + 1] == ord(first)]
        if second:
            hit = hit[hit + 2 < n]
            hit = hit[(points[hit + 2] == ord(second)) & ~fresh[hit + 2]]
        past = hit + 2 + len(second)
        starts[hit + 1] = False
        starts[past[past < n]] = True
    return at[starts]


class Vocabulary:
    """Merges and tokens of a tokenizers file at ``path``, as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ids = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        content = {i: bytes(byte[c] for c in t) for t, i in ids.items() if t not in special}
        self.special = {t.encode(): i for t, i in special.items()}
        self.mark = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if special else None
        self.inside = np.zeros((256, 256), bool)
        for t in content.values():
            x = np.frombuffer(t, np.uint8)
            self.inside[x[:-1], x[1:]] = True
        self.of_byte = np.zeros(256, np.int32)
        for t, i in content.items():
            if len(i) == 1:
                self.of_byte[i[0]] = t
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order.astype(np.int32), made
        all_content = content | {i: t for t, i in self.special.items()}
        top = max(all_content) + 1
        self.length = np.array([len(all_content.get(i, b"")) for i in range(top + 1)], np.int64)  # the last: no such id
        self.base = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(all_content.get(i, b"") for i in range(top)), np.uint8)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, _NONE without one."""
        want = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], _NONE)

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of one fragment: its lowest-ranked leftmost pair is merged until none is left."""
        s, n = symbols.tolist(), len(symbols)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s[i], s[i + 1]) for i, r in enumerate(self._ranks(symbols[:-1], symbols[1:]).tolist()) if r != _NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            pair = (s[i], s[j])
            if pair not in known:
                known[pair] = int(self._ranks(np.array(pair[:1]), np.array(pair[1:]))[0])
            if known[pair] != _NONE:
                heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j], after[i] = int(self.made[r]), -1, after[j]
            if after[i] < n:
                prior[after[i]] = i
                push(i, after[i])
            if prior[i] >= 0:
                push(prior[i], i)
        return np.array([x for x in s if x >= 0], np.int32)

    def merged(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many) of fragments, each merged by itself; one round merges the lowest pair of every fragment."""
        size = ends - starts
        many = [(self._merge_long(self.of_byte[b[starts[k] : ends[k]]]), k) for k in np.flatnonzero(size > LONG).tolist()]
        parts = [ids for ids, _ in many]
        owners = [np.full(len(ids), k) for ids, k in many]
        short = np.where(size > LONG, 0, size)
        owner = np.repeat(np.arange(len(starts)), short)
        symbols = self.of_byte[b[np.repeat(starts - (np.cumsum(short) - short), short) + np.arange(len(owner))]]
        while len(symbols):
            new = np.append(True, owner[1:] != owner[:-1])
            rank = np.append(self._ranks(symbols[:-1], symbols[1:]), _NONE)
            rank[np.append(new[1:], True)] = _NONE
            first = np.flatnonzero(new)
            least = np.minimum.reduceat(rank, first)[np.cumsum(new) - 1]
            done = least == _NONE
            parts.append(symbols[done])
            owners.append(owner[done])
            # Of pairs that overlap (three times one symbol) every second is merged, from the left.
            hit = np.flatnonzero((rank == least) & ~done)
            lead = np.append(True, np.diff(hit) != 1)[: len(hit)]
            place = np.arange(len(hit))
            hit = hit[(place - np.maximum.accumulate(np.where(lead, place, 0))) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            keep = ~done
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        owner = np.concatenate([*owners, np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([*parts, np.zeros(0, np.int32)])[order], np.bincount(owner, minlength=len(starts))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's) of texts that lie one after another in ``data``."""
        b = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(b):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        raw = b.tobytes()
        edge = np.zeros(len(b) + 1, bool)
        edge[offsets] = True
        marks = []
        if self.mark is not None and self.mark.search(raw):
            marks = [m for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.mark.finditer(raw, x, y)]
        for m in marks:
            edge[[m.start(), m.end()]] = True
        cut = edge.copy()
        cut[pretokens(b, raw, edge)] = True
        cut[1:-1] |= ~self.inside[b[:-1], b[1:]]
        for m in marks:
            cut[m.start() + 1 : m.end()] = False
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        given = {m.start(): self.special[m[0]] for m in marks}
        _, pick, kind = np.unique(words.hash_ranges(b, starts, ends), return_index=True, return_inverse=True)
        # Fragments that share a hash and not their bytes stand for themselves.
        wrong = np.flatnonzero(~words.same_ranges(b, starts, ends, starts[pick][kind], ends[pick][kind]))
        kind[wrong] = len(pick) + np.arange(len(wrong))
        pick = np.append(pick, wrong)
        pool, n = self.merged(b, starts[pick], ends[pick])
        if given:
            place = np.searchsorted(starts, list(given))
            kind[place] = len(pick) + np.arange(len(place))
            pool, n = np.append(pool, np.array(list(given.values()), np.int32)), np.append(n, np.ones(len(place), np.int64))
        base, size = np.cumsum(n) - n, n[kind]
        stop = np.cumsum(size)
        ids = pool[np.repeat(base[kind] - (stop - size), size) + np.arange(stop[-1])]
        return ids, np.append(0, stop)[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, offsets of each text's) of ids that lie one after another; an id without a token gives nothing."""
        ids = ids[offsets[0] : offsets[-1]]
        ids = np.where((ids >= 0) & (ids < len(self.length) - 1), ids, len(self.length) - 1)
        size = self.length[ids]
        stop = np.append(0, np.cumsum(size))
        b = self.bytes[np.repeat(self.base[ids] - stop[:-1], size) + np.arange(stop[-1])]
        return b, stop[offsets - offsets[0]]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a worker; read once."""
    return Vocabulary(path)


def _parts(b: np.ndarray, begin: int, end: int, limit: int) -> list[int]:
    """Offsets that cut a text into parts of about ``limit`` bytes, each before a blank and a visible ASCII character."""
    cuts = [begin]
    while end - cuts[-1] > limit:
        place = cuts[-1] + limit
        while place < end:
            window = b[place : min(place + limit, end) + 1]
            hit = np.flatnonzero((window[:-1] == 32) & (window[1:] > 32) & (window[1:] < 127))
            if len(hit):
                place += int(hit[0])
                break
            place += limit
        if place >= end:
            break
        cuts.append(place)
    return [*cuts, end]


def encode_column(vocab: Vocabulary, column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, ids, offsets) of a text column, a part of its rows at a time."""
    data, offsets = words.buffers(column)
    blank = any(b" " in mark for mark in vocab.special)
    for i, j in words.chunks(offsets, limit):
        if j - i > 1 or offsets[j] - offsets[i] <= limit or blank:
            yield i, j, *vocab.encode(data, offsets[i : j + 1])
            continue
        cuts = _parts(data, int(offsets[i]), int(offsets[j]), limit)
        ids = np.concatenate([vocab.encode(data, np.array(c))[0] for c in zip(cuts[:-1], cuts[1:], strict=True)])
        yield i, j, ids, np.array([0, len(ids)])


def _columns(batch: pa.RecordBatch, i: int, j: int, **made: pa.Array) -> pa.RecordBatch:
    part = batch.slice(i, j - i)
    return pa.RecordBatch.from_arrays([part.column("doc_id"), *made.values()], ["doc_id", *made])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of every text of ``docs``(doc_id, text and more) by the tokenizers file at ``path``.

    Ids are those of that library without added special tokens; their strings in a text are
    the special tokens. Null text counts as empty: no ids. Repeated rows stay, a null doc_id
    stays null, other columns are not carried, and an empty table gives no rows.
    """

    @memory.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for i, j, ids, offsets in encode_column(vocab, batch.column("text")):
                yield _columns(batch, i, j, ids=pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def _texts(b: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts of bytes; a broken character becomes U+FFFD, as in the library."""
    raw = b.tobytes()
    try:
        raw.decode()
        whole = not (b[offsets[:-1][np.diff(offsets) > 0]] & 0xC0 == 0x80).any()
    except UnicodeDecodeError:
        whole = False
    if whole:
        return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw))
    return pa.array([raw[x:y].decode(errors="replace") for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())


def decode_documents(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text of ``tokens``(doc_id, ids): the text that the ids stand for, special tokens included.

    Null ids count as none: an empty text.
    """

    @memory.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ids = batch.column("ids")
            lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.append(0, np.cumsum(lengths))
            values = ids.flatten().to_numpy(zero_copy_only=False)
            for i, j in words.chunks(offsets, CHUNK):
                yield _columns(batch, i, j, ids=ids.slice(i, j - i), text=_texts(*vocab.decode(values, offsets[i : j + 1])))

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")

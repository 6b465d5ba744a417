"""Windows of a segmented index, made and searched in the tasks that hold them: nothing is dealt for a posting or a (question, window) pair.

A window is one row: its terms, each with the number of items that hold it, the largest
frequency and the least length among them, which bound the weight of any of them, and its
items, whose terms are named by their places in the window's list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import scratch
from quern.operators import best as N
from quern.operators.search import K1, B

#: Items of a window, as a power of two.
WINDOW_BITS = 3
#: Parts of the items that share their least word hash, at least.
SALTS = 64
_LISTS = "terms array<string>, n array<int>, max_tf array<int>, min_len array<int>"
_ITEMS = "items array<struct<doc: bigint, ord: int, len: int, at: array<int>, tf: array<int>>>"
SCHEMA = f"window long, {_LISTS}, {_ITEMS}"


def _lengths(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _begins(lengths: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(lengths))


def _listed(begins: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), values)


def _packed(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
    """Windows of neighbouring items, the first of them with ``number``."""
    size, lists, length = batch.num_rows, batch.column("terms"), batch.column("len").to_numpy()
    per_item = _lengths(lists)
    item = np.repeat(np.arange(size), per_item)
    term, tf = lists.flatten().flatten()
    tf, named = tf.to_numpy(zero_copy_only=False), term.cast(pa.string()).dictionary_encode()
    wide, windows = max(1, len(named.dictionary)), -(-size // (1 << WINDOW_BITS))
    window = item >> WINDOW_BITS
    cell = window * wide + named.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(cell, kind="stable")
    begins = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0)) if len(cell) else np.zeros(0, np.int64)
    place = np.zeros(len(cell), np.int64)
    place[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(cell))))
    distinct = cell[order][begins]
    of_window = np.searchsorted(distinct, np.arange(windows + 1) * wide)
    n = np.diff(np.append(begins, len(cell)))
    max_tf, min_len = (f.reduceat(v[order], begins) if len(begins) else np.zeros(0, np.int64) for f, v in ((np.maximum, tf), (np.minimum, length[item])))
    ints = lambda v: pa.array(np.asarray(v, np.int32))
    own = _begins(per_item)
    fields = [batch.column("doc"), batch.column("ord"), batch.column("len"), _listed(own, ints(place - of_window[window])), _listed(own, ints(tf))]
    items = pa.StructArray.from_arrays(fields, ["doc", "ord", "len", "at", "tf"])
    columns = [_listed(of_window, v) for v in (named.dictionary.take(pa.array(distinct % wide)), ints(n), ints(max_tf), ints(min_len))]
    held = _listed(np.minimum(np.arange(windows + 1) << WINDOW_BITS, size), items)
    return pa.RecordBatch.from_arrays([pa.array(number + np.arange(windows)), *columns, held], names=["window", "terms", "n", "max_tf", "min_len", "items"])


def pack(counted: DataFrame) -> DataFrame:
    """Windows of ``counted``(doc, ord, len, terms: (term, tf)), items that share their least word hash side by side; only items are dealt.

    A mass of copies shares that hash, and so do many items by a frequent word, so it is
    dealt by the document as well, in as many parts as a shuffle has.
    """
    spark = counted.sparkSession
    scratch.prepare(spark)
    salts = max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    near = counted.select("doc", "ord", "len", "terms", F.array_min(F.transform("terms.term", lambda t: F.xxhash64(t))).alias("_near"), F.pmod(F.xxhash64("doc"), F.lit(salts)).alias("_salt"))
    placed = near.repartition("_near", "_salt").sortWithinPartitions("_near", "doc", "ord").select("doc", "ord", "len", "terms")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            if batch.num_rows:
                out = _packed(batch, number)
                number += out.num_rows
                yield out

    return placed.mapInArrow(windows, SCHEMA)


#: Postings whose shares a task gathers before it sums them up.
GATHERED = 1 << 20


def shares(windows: DataFrame, mean: float) -> DataFrame:
    """(term, n, most, total): how many postings of a term runs of ``windows`` hold, the largest of their shares and the sum; items whose places are in a column ``dead`` are none."""
    scratch.prepare(windows.sparkSession)
    columns = [c for c in ("terms", "items", "dead") if c in windows.columns]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(_shares(batch, mean))
            size += held[-1].num_rows
            if size >= GATHERED:
                yield from _totals(held)
                held, size = [], 0
        yield from _totals(held)

    return windows.select(*columns).mapInArrow(add, "term string, n long, most double, total double")


def _shares(batch: pa.RecordBatch, mean: float) -> pa.RecordBatch:
    """(term, n, most, total) of a batch's postings."""
    named, lists = batch.column("terms"), batch.column("items")
    begins, first = _begins(_lengths(named)), _begins(_lengths(lists))
    _, _, length, at, tf = lists.flatten().flatten()
    own = np.repeat(np.arange(len(length)), _lengths(at))
    window = np.repeat(np.arange(batch.num_rows), np.diff(first))
    words = named.flatten().dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False)[begins[window[own]] + at.flatten().to_numpy(zero_copy_only=False)]
    share = _share(tf.flatten().to_numpy(zero_copy_only=False).astype(float), length.to_numpy(zero_copy_only=False)[own], mean)
    if "dead" in batch.schema.names:
        dead, alive = batch.column("dead"), np.ones(len(length), bool)
        alive[first[np.repeat(np.arange(batch.num_rows), _lengths(dead))] + dead.flatten().to_numpy(zero_copy_only=False)] = False
        code, share = code[alive[own]], share[alive[own]]
    size = len(words.dictionary)
    n, total, most = np.bincount(code, minlength=size), np.bincount(code, weights=share, minlength=size).astype(float, copy=False), np.zeros(size)
    np.maximum.at(most, code, share)
    some = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(some)), pa.array(n[some]), pa.array(most[some]), pa.array(total[some])], names=["term", "n", "most", "total"])


def _totals(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    if not held:
        return []
    sums = pa.Table.from_batches(held).group_by("term", use_threads=False).aggregate([("n", "sum"), ("most", "max"), ("total", "sum")])
    return sums.select(["term", "n_sum", "most_max", "total_sum"]).rename_columns(["term", "n", "most", "total"]).to_batches()


class _Batch:
    """Windows of a batch as arrays: blocks by window, items by window, what may be ranked."""

    def __init__(self, a: N._Asked, known: pa.Array, batch: pa.RecordBatch) -> None:
        self.a, self.batch, self.size = a, batch, batch.num_rows
        lists = batch.column("terms")
        self.begins = _begins(_lengths(lists))
        self.term = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.asked = np.flatnonzero(self.term >= 0)
        self.allow = None
        if "allow" in batch.schema.names:
            lists = batch.column("allow")
            item, q = lists.flatten().flatten()
            who = {name: i for i, name in enumerate(a.names)}
            named = None if q.null_count == len(q) else np.array([who.get(x, -1) for x in q.to_pylist()], np.int64)
            self.allow = np.repeat(np.arange(self.size), _lengths(lists)), item.to_numpy(zero_copy_only=False).astype(np.int64), named

    def ids(self) -> list[np.ndarray]:
        return [self.batch.column(c).to_numpy() for c in ("seg", "window")]

    def _of_blocks(self, name: str) -> np.ndarray:
        return self.batch.column(name).flatten().to_numpy(zero_copy_only=False)[self.asked].astype(float)

    def _window(self) -> np.ndarray:
        return np.repeat(np.arange(self.size), np.diff(self.begins))[self.asked]

    def bounds(self, mean: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, past the last, bounds) of runs of windows, questions by windows; 0 where a window holds nothing for a question."""
        t, tf, length = self.term[self.asked], self._of_blocks("max_tf"), self._of_blocks("min_len")
        for x, y, sums in N.added(self.a, t, self._window(), self.a.idf[t] * _share(tf, length, mean), self.size):
            if self.allow is not None and self.allow[2] is not None:
                window, _, q = self.allow
                ok, some = np.zeros(sums.shape, bool), (window >= x) & (window < y) & (q >= 0)
                ok[q[some], window[some] - x] = True
                sums[~ok] = 0
            yield x, y, sums

    def held(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """The same of the numbers of postings."""
        return N.added(self.a, self.term[self.asked], self._window(), self._of_blocks("n"), self.size)

    def items(self) -> None:
        """Take the items apart."""
        lists = self.batch.column("items")
        doc, order, length, at, tf = lists.flatten().flatten()
        self.first = _begins(_lengths(lists))
        self.window = np.repeat(np.arange(self.size), np.diff(self.first))
        self.ranked = doc.is_valid().to_numpy(zero_copy_only=False) & order.is_valid().to_numpy(zero_copy_only=False)
        self.doc, self.ord = (c.fill_null(0).to_numpy(zero_copy_only=False) for c in (doc, order))
        self.len, per_item = length.to_numpy(zero_copy_only=False), _lengths(at)
        own = np.repeat(np.arange(len(doc)), per_item)
        term = self.term[self.begins[self.window[own]] + at.flatten().to_numpy(zero_copy_only=False)]
        self.own, self.posted, self.tf = own[term >= 0], term[term >= 0], tf.flatten().to_numpy(zero_copy_only=False)[term >= 0].astype(float)
        if "dead" in self.batch.schema.names:
            dead = self.batch.column("dead")
            self.ranked[self.first[np.repeat(np.arange(self.size), _lengths(dead))] + dead.flatten().to_numpy(zero_copy_only=False)] = False
        if self.allow is not None and self.allow[2] is None:
            allowed = np.zeros(len(self.ranked), bool)
            allowed[self.first[self.allow[0]] + self.allow[1]] = True
            self.ranked &= allowed

    def scores(self, x: int, y: int, opened: np.ndarray, mean: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, past the last, scores) of runs of the items in windows ``x`` to ``y`` - 1, for the questions that have opened their windows."""
        lo, hi = self.first[x], self.first[y]
        p, r = np.searchsorted(self.own, (lo, hi))
        some = p + np.flatnonzero(opened.any(axis=0)[self.window[self.own[p:r]] - x])
        own, t, tf = self.own[some], self.posted[some], self.tf[some]
        of = self.window[lo:hi] - x
        for i, j, sums in N.added(self.a, t, own - lo, self.a.idf[t] * _share(tf, self.len[own], mean), hi - lo, lambda q, item: opened[q, of[item]]):
            sums[sums == 0] = -np.inf
            sums[:, ~self.ranked[lo + i : lo + j]] = -np.inf
            if self.allow is not None and self.allow[2] is not None:
                window, item, q = self.allow
                ok, place = np.zeros(sums.shape, bool), self.first[window] + item - lo
                some = (place >= i) & (place < j) & (q >= 0)
                ok[q[some], place[some] - i] = True
                sums[~ok] = -np.inf
            yield lo + i, lo + j, sums


def _share(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """BM25 without its share of rarity."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _each(windows: DataFrame, a: N._Asked, ddl: str, each: Callable[[Iterator[_Batch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    scratch.prepare(windows.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(a.terms, pa.string())
        return each(_Batch(a, known, b) for b in batches if b.num_rows)

    return windows.mapInArrow(scan, ddl)


_PAIR = "q long, seg int, window long"


def _pairs(a: N._Asked, b: _Batch, x: int, some: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    q, at = np.nonzero(some)
    seg, window = b.ids()
    columns = {"q": pa.array(np.array(a.names, np.int64)[q]), "seg": pa.array(seg[at + x].astype(np.int32)), "window": pa.array(window[at + x])}
    return pa.RecordBatch.from_pydict(columns | {c: pa.array(v[q, at]) for c, v in more.items()})


def bounds(windows: DataFrame, a: N._Asked, mean: float) -> DataFrame:
    """(q, seg, window, bound, n) of every window that holds a term of a question."""

    def each(batches: Iterator[_Batch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for (x, _, sums), (_, _, n) in zip(b.bounds(mean), b.held(), strict=True):
                yield _pairs(a, b, x, sums > 0, bound=sums, n=n.astype(np.int64))

    return _each(windows, a, f"{_PAIR}, bound double, n long", each)


def highest(windows: DataFrame, a: N._Asked, mean: float, k: int) -> DataFrame:
    """(q, seg, window, score): each task's ``k`` windows of the highest bounds."""
    schema = pa.schema([("q", pa.int64()), ("seg", pa.int32()), ("window", pa.int64()), ("score", pa.float64())])

    def each(batches: Iterator[_Batch]) -> Iterator[pa.RecordBatch]:
        kept = N.Kept(len(a.names), k, 2)
        for b in batches:
            seg, window = b.ids()
            for x, y, sums in b.bounds(mean):
                sums[sums == 0] = -np.inf
                kept.add(sums, [seg[x:y], window[x:y]])
        yield N._table(a.names, kept, ("seg", "window"), schema)

    return _each(windows, a, f"{_PAIR}, score double", each)


def _open(b: _Batch, mean: float, least: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray]]:
    """Which windows each question reads: those of its own in a column ``asks``, or whose bound reaches ``least``."""
    for x, y, sums in b.bounds(mean):
        if least is None:
            lists = b.batch.column("asks")
            who = {name: i for i, name in enumerate(b.a.names)}
            q, window = np.array([who[n] for n in lists.flatten().to_pylist()], np.int64), np.repeat(np.arange(b.size), _lengths(lists))
            opened, some = np.zeros(sums.shape, bool), (window >= x) & (window < y)
            opened[q[some], window[some] - x] = True
        else:
            # A bound is a sum in another order than a score: what comes within rounding is read.
            opened = sums >= least[:, None] - 1e-6
        yield x, y, opened & (sums > 0)


def opened(windows: DataFrame, a: N._Asked, mean: float, least: np.ndarray) -> DataFrame:
    """(q, seg, window) whose bound reaches the question's ``least``."""
    return _each(windows, a, _PAIR, lambda batches: (_pairs(a, b, x, some) for b in batches for x, _, some in _open(b, mean, least)))


def hits(windows: DataFrame, a: N._Asked, mean: float, k: int, least: np.ndarray | None = None) -> DataFrame:
    """(q, doc, ord, score): each task's ``k`` best items in the windows that a question reads."""
    schema = pa.schema([("q", pa.int64()), ("doc", pa.int64()), ("ord", pa.int32()), ("score", pa.float64())])

    def each(batches: Iterator[_Batch]) -> Iterator[pa.RecordBatch]:
        kept = N.Kept(len(a.names), k, 2)
        for b in batches:
            b.items()
            for x, y, some in _open(b, mean, least):
                for i, j, sums in b.scores(x, y, some, mean):
                    kept.add(sums, [b.doc[i:j], b.ord[i:j]])
        yield N._table(a.names, kept, ("doc", "ord"), schema)

    return _each(windows, a, "q long, doc long, ord int, score double", each)

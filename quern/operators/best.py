"""The best items of each question of a batch, kept while items pass by: no row of a (question, item) pair is made or moved.

Items are read where they lie. A task scores a few of them at once against all questions
and keeps k for each; only those rows are dealt and ranked. The questions, whose number is
checked, go to every task as a broadcast would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import scratch
from quern.operators import bitmaps as M
from quern.operators.search import K1, B, Kept, top, vector_topk

#: Rows of questions that may go to every task, and scores that a task holds at once.
MOST_TERMS, MOST_VECTORS, CELLS = 200_000, 20_000, 1 << 20
#: Bitmaps of filters, of 4 KB each, that may go to every task.
MOST_BITMAPS = 4096
#: The filters of an item, where questions have one each.
FILTERS = "filters"


@dataclass(frozen=True)
class _Asked:
    """Questions by their place; for each distinct term its rarity and the places of those that ask for it."""

    names: list
    terms: list[str]
    idf: np.ndarray
    start: np.ndarray
    who: np.ndarray


def _asks(rows: list[tuple]) -> _Asked:
    """Of rows (q, term, idf); a repeated row counts again."""
    names = sorted({q for q, _, _ in rows})
    place = {q: i for i, q in enumerate(names)}
    terms = sorted({t: idf for _, t, idf in rows}.items())
    number = {t: i for i, (t, _) in enumerate(terms)}
    pairs = sorted((number[t], place[q]) for q, t, _ in rows)
    which = np.array([t for t, _ in pairs], np.int64)
    return _Asked(names, [t for t, _ in terms], np.array([i for _, i in terms], float), np.searchsorted(which, np.arange(len(terms) + 1)), np.array([q for _, q in pairs], np.int64))


def _sums(a: _Asked, known: pa.Array, batch: pa.RecordBatch, weigh) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, past the last, sums): for runs of a batch's items the sums of what their terms weigh, questions by items."""
    lists, size = batch.column("terms"), batch.num_rows
    owner = np.repeat(np.arange(size), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    term, tf = lists.flatten().flatten()
    t = pc.fill_null(pc.index_in(term, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    own, tf, t = owner[t >= 0], tf.to_numpy()[t >= 0].astype(float), t[t >= 0]
    yield from added(a, t, own, weigh(t, tf, own), size)


def added(a: _Asked, t: np.ndarray, own: np.ndarray, w: np.ndarray, size: int, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, past the last, sums) for runs of ``size`` items: weights ``w`` of terms ``t`` of items ``own``, in order, for those that ask for them; ``wanted`` tells which (question, item) pairs count."""
    n, times = len(a.names), np.diff(a.start)[t]
    for x, y in _slices(n + np.bincount(own, weights=times, minlength=size)):
        lo, hi = np.searchsorted(own, (x, y))
        one = np.repeat(np.arange(lo, hi), times[lo:hi])
        inside = np.arange(len(one)) - np.repeat(np.cumsum(times[lo:hi]) - times[lo:hi], times[lo:hi])
        who = a.who[a.start[t[one]] + inside]
        if wanted is not None:
            some = wanted(who, own[one])
            who, one = who[some], one[some]
        # Without any pair the sums are of integers, which hold no infinity.
        yield x, y, np.bincount(who * (y - x) + own[one] - x, weights=w[one], minlength=n * (y - x)).astype(float, copy=False).reshape(n, y - x)


def _permitted(batch: pa.RecordBatch, wanted: list | None) -> np.ndarray | None:
    """Questions by items: whether the filter of one is among those of the other."""
    if wanted is None:
        return None
    kinds = sorted(set(wanted))
    lists = batch.column(FILTERS)
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    kind = pc.fill_null(pc.index_in(lists.flatten(), value_set=pa.array(kinds, pa.string())), -1).to_numpy(zero_copy_only=False)
    under = np.zeros((len(kinds) + 1, len(lists)), bool)
    under[kind, owner] = True
    return under[[kinds.index(w) for w in wanted]]


def _slices(cost: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of items whose costs sum up to about CELLS."""
    total, at = np.append(0, np.cumsum(cost)), 0
    while at < len(cost):
        end = max(at + 1, int(np.searchsorted(total, total[at] + CELLS, "right")) - 1)
        yield at, end
        at = end


def _table(names: list, kept: Kept, ids: tuple[str, ...], schema: pa.Schema) -> pa.RecordBatch:
    q, score, *held = kept.held
    columns = [pa.array([names[i] for i in q.tolist()], schema.field("q").type), *(pa.array(h, schema.field(c).type) for c, h in zip(ids, held, strict=True)), pa.array(score)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _out(items: DataFrame, ids: tuple[str, ...]) -> tuple[str, pa.Schema]:
    kinds = [(c, items.schema[c].dataType.simpleString()) for c in ids]
    types = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    rows = [("q", "bigint"), *kinds, ("score", "double")]
    return ", ".join(f"{c} {t}" for c, t in rows), pa.schema([(c, types[t]) for c, t in rows])


def by_terms(items: DataFrame, asked: list, mean: float, k: int, wanted: dict | None = None) -> DataFrame:
    """(q, doc, ord, score): each task's ``k`` best of ``items``(doc, ord, len, terms: (term, tf)) for ``asked``, rows (q, term, idf), by BM25; repeated terms count again.

    ``wanted``: the filter of each question, if items carry FILTERS.
    """
    scratch.prepare(items.sparkSession)
    a = _asks([(r["q"], r["term"], r["idf"]) for r in asked])
    filters = [wanted[q] for q in a.names] if wanted is not None else None
    ddl, schema = _out(items, ("doc", "ord"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, known = Kept(len(a.names), k, 2), pa.array(a.terms, pa.string())
        for batch in batches:
            doc, order, length = (batch.column(c).to_numpy() for c in ("doc", "ord", "len"))
            permitted = _permitted(batch, filters)
            weigh = lambda t, tf, own: a.idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[own] / mean))  # noqa: E731, B023
            for x, y, sums in _sums(a, known, batch, weigh):
                sums[sums == 0] = -np.inf
                if permitted is not None:
                    sums[~permitted[:, x:y]] = -np.inf
                kept.add(sums, [doc[x:y], order[x:y]])
        yield _table(a.names, kept, ("doc", "ord"), schema)

    return items.mapInArrow(score, ddl)


def matches(items: DataFrame, asked: list) -> DataFrame:
    """(q, doc, ord, n): how many words of each of ``items``(doc, ord, terms: (term, tf)) are terms of a question of ``asked``, rows (q, term), where any is; nothing is dealt."""
    scratch.prepare(items.sparkSession)
    a = _asks([(r["q"], r["term"], 1.0) for r in asked])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(a.terms, pa.string())
        for batch in batches:
            doc, order = batch.column("doc"), batch.column("ord")
            for x, _, sums in _sums(a, known, batch, lambda t, tf, own: tf):
                at, q = np.nonzero(sums.T)
                named = pa.array(a.names, pa.int64()).take(pa.array(q))
                where = pa.array(at + x)
                yield pa.RecordBatch.from_arrays([named, doc.take(where), order.take(where), pa.array(sums.T[at, q].astype(np.int64))], names=["q", "doc", "ord", "n"])

    return items.select("doc", "ord", "terms").mapInArrow(count, "q long, doc long, ord int, n long")


def by_vectors(items: DataFrame, asked: list, k: int, ids: tuple[str, ...] = ("doc",), wanted: dict | None = None) -> DataFrame:
    """(q, ids, score): each task's ``k`` largest inner products of ``items``(ids, v) for ``asked``, rows (q, v); only equal lengths meet."""
    scratch.prepare(items.sparkSession)
    asked = sorted(((r["q"], r["v"]) for r in asked), key=lambda r: r[0])
    names = [q for q, _ in asked]
    by_length = {d: np.array([i for i, (_, v) in enumerate(asked) if len(v) == d]) for d in {len(v) for _, v in asked}}
    stacked = {d: np.array([asked[i][1] for i in at], float) for d, at in by_length.items()}
    filters = [wanted[q] for q in names] if wanted is not None else None
    ddl, schema = _out(items, ids)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(len(names), k, len(ids))
        for batch in batches:
            own, v = [batch.column(c).to_numpy() for c in ids], batch.column("v")
            permitted, lengths = _permitted(batch, filters), v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for d, at in by_length.items():
                some = np.flatnonzero(lengths == d)
                if not d or not len(some):
                    continue
                y = v.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                for a, b in _slices(np.full(len(some), len(names))):
                    scores = np.full((len(names), b - a), -np.inf)
                    scores[at] = stacked[d] @ y[a:b].T
                    if permitted is not None:
                        scores[~permitted[:, some[a:b]]] = -np.inf
                    kept.add(scores, [i[some[a:b]] for i in own])
        yield _table(names, kept, ids, schema)

    return items.mapInArrow(score, ddl)


def under(items: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """``items`` that ``allowed`` has, by its columns doc and ord; with a column filter each item carries its FILTERS."""
    if allowed is None:
        return items
    on = [c for c in allowed.columns if c != "filter"]
    sets = allowed.groupBy(*on).agg(F.collect_set("filter").alias(FILTERS)) if "filter" in allowed.columns else allowed.distinct()
    few = sets.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    if not few and on == ["doc"] and (marked := _marked(items, allowed)) is not None:
        return marked
    return items.join(F.broadcast(sets) if few else sets, on)


def _marked(items: DataFrame, allowed: DataFrame) -> DataFrame | None:
    """As :func:`under`, by bitmaps of documents that go to every task, so that items stay where they are; none if there would be too many or ids are negative."""
    if allowed.where("doc < 0").limit(1).count():
        return None
    name = F.col("filter") if "filter" in allowed.columns else F.lit("")
    sets = scratch.save(M.index(allowed.select("doc", name.alias("value"))), "allowed")
    if sets.limit(MOST_BITMAPS + 1).count() > MOST_BITMAPS:
        scratch.drop(sets)
        return None
    by_bucket = sets.groupBy("bucket").agg(F.collect_list(F.struct("value", "bits")).alias("_sets"))
    placed = items.where("doc >= 0").withColumn("bucket", F.bitmap_bucket_number("doc")).join(F.broadcast(by_bucket), "bucket")
    holding = F.filter("_sets", lambda s: M.holds(s["bits"], F.col("doc")))
    held = placed.withColumn(FILTERS, F.transform(holding, lambda s: s["value"])).where(F.size(FILTERS) > 0)
    return held.select(*items.columns, *([FILTERS] if "filter" in allowed.columns else []))


def nearest(items: DataFrame, asked: DataFrame, k: int, ids: tuple[str, ...] = ("doc",), allowed: DataFrame | None = None) -> DataFrame:
    """(q, ids, score, rank): the ``k`` largest cosines of unit vectors ``items``(ids, v) for each of ``asked``(q, v), exactly; ties to the smaller id.

    With ``allowed``(filter, doc) the questions carry a ``filter`` too. More questions than
    may go to every task meet the items in blocks.
    """
    chosen = ["q", "v", *(["filter"] if allowed is not None else [])]
    rows = asked.select(F.col("q").cast("long").alias("q"), *chosen[1:]).limit(MOST_VECTORS + 1).collect()  # as many as may be broadcast
    if len(rows) > MOST_VECTORS:
        key = (F.lit("") if allowed is None else F.col("filter")).alias("key")
        held = items if allowed is None else items.join(allowed, "doc")
        return vector_topk(asked.select("q", "v", key), held.select(*ids, "v", key), k, same=True, ids=ids)
    wanted = {r["q"]: r["filter"] for r in rows} if allowed is not None else None
    return top(by_vectors(under(items, allowed), rows, k, ids, wanted), k, F.round("score", 9).desc(), *ids)

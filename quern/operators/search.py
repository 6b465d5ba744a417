"""Keyword, vector and hybrid ranking of a batch of queries in one job.

Filters act before any list is cut, corpus statistics are taken before filters, and every
ranking ends with the id, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import scratch
from quern.functions import text as X
from quern.functions import vectors as V

POOL, LIMIT, RRF_K = 100, 10, 60
K1, B = 1.2, 0.75
#: Queries that a task of a vector search holds at most, about, and that it holds at least where there are cores left; queries and vectors that are multiplied at once.
BLOCK, LEAST, ROWS, COLUMNS = 1 << 15, 512, 256, 4096


def postings(docs: DataFrame, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """(term, doc, tf) with folded terms."""
    terms = docs.select(F.col(doc).alias("doc"), F.explode(X.words(X.fold(F.col(body)))).alias("term"))
    return terms.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def terms_of(queries: DataFrame, q: str, body: str) -> DataFrame:
    """(q, term): folded query terms; words that fold alike count once each."""
    return queries.select(F.col(q).alias("q"), F.explode(F.transform(X.query_terms(F.col(body)), X.fold)).alias("term"))


def bm25(docs: DataFrame, terms: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(q, doc, score) of every document that holds a term; higher is better.

    The index is cut to the queries' terms before it is grouped and carries the lengths of
    its documents. ``allowed``: (q, doc) pairs or (doc) that may be ranked.
    """
    w = docs.select(F.col("doc_id").alias("doc"), X.words(X.fold(F.col("text"))).alias("w"))
    stats = w.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size("w")).alias("avg_len"))
    wanted = terms.select("term").distinct()
    held = w.select("doc", F.size("w").alias("len"), F.explode("w").alias("term")).join(wanted, "term", "left_semi")
    index = held.groupBy("term", "doc", "len").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    df = index.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    hits = terms.join(df, "term").join(index, "term")
    if allowed is not None:
        hits = hits.join(allowed, allowed.columns, "left_semi")
    hits = hits.crossJoin(F.broadcast(stats))  # one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    one = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return hits.groupBy("q", "doc").agg(F.sum(one).alias("score"))


def askable(questions: DataFrame, body: str, limit: int) -> DataFrame:
    """Questions that have words; none if nothing is to be returned."""
    return questions.where(F.lit(limit > 0) & (F.coalesce(F.trim(body), F.lit("")) != ""))


def responses(hits: DataFrame) -> DataFrame:
    """(q, n, body): the hits(q, rank, id, url, title, score) of each question as one JSON text, in order.

    Hits without id or title, and links that are not https, are left out. A list is at most
    as long as the limit of the search that found it. Hits may also have a ``passage`` and
    ``highlights``, an array of (start, length); those that do not lie in the passage go.
    """
    shown = hits.where(F.col("id").isNotNull() & (F.coalesce(F.trim("title"), F.lit("")) != "") & F.coalesce(F.lower("url").startswith("https://"), F.lit(False)))
    marked = []
    if "passage" in hits.columns:
        fits = lambda h: (h["start"] >= 0) & (h["length"] > 0) & (h["start"] + h["length"] <= F.length("passage"))
        valid = F.filter("highlights", lambda h: F.coalesce(fits(h), F.lit(False)))
        marked = [F.col("passage"), F.coalesce(valid, F.array().cast("array<struct<start: int, length: int>>")).alias("highlights")]
    one = F.struct("rank", F.col("id").cast("string").alias("id"), "title", "url", F.bround("score", 6).alias("score"), *marked)
    return shown.groupBy("q").agg(F.array_sort(F.collect_list(one)).alias("h")).select("q", F.size("h").cast("long").alias("n"), F.to_json("h").alias("body"))


def passage_search(postings_hits: DataFrame, near: DataFrame, pool: int = POOL, limit: int = LIMIT) -> DataFrame:
    """(q, doc, chunk, rank, score) for scored passages (q, doc, ord, score) of a keyword and (q, doc, ord, rank) of a vector search."""
    keyword = top(postings_hits, pool, F.round("score", 9).desc(), "doc", "ord")
    tag = lambda df, n: df.select("q", F.lit(n).alias("list"), F.struct("doc", "ord").alias("chunk"), "doc", "rank")
    return one_passage(tag(keyword, 0).unionByName(tag(near.where(F.col("rank") <= pool), 1)), limit)


def top(scored: DataFrame, k: int, *by: Column | str, within: tuple[str, ...] = ("q",)) -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1."""
    w = Window.partitionBy(*within).orderBy(*by)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def shared(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """``rows``, written once and broadcast where they are few, so that what they are joined with is neither dealt nor sorted."""
    held = scratch.save(rows, "shared")
    return F.broadcast(held) if held.limit(most + 1).count() <= most else held


def best_first(scored: DataFrame, k: int) -> DataFrame:
    return top(scored, k, F.round("score", 9).desc(), "doc")


class Kept:
    """The first ``k`` of each of ``n`` questions by (score to nine places, ids). What may be among them waits until there is as much of it as is kept."""

    def __init__(self, n: int, k: int, ids: int) -> None:
        self.n, self.k = n, k
        self.least = np.full(n, -np.inf)
        self._held = [np.zeros(0, np.int64), np.zeros(0), *(np.zeros(0, np.int64) for _ in range(ids))]
        self._waiting: list[list[np.ndarray]] = []
        self._rows, self._full = 0, False

    @property
    def held(self) -> list[np.ndarray]:
        """(question, score, ids) by question and rank."""
        self._merge()
        return self._held

    def add(self, scores: np.ndarray, ids: list[np.ndarray]) -> None:
        """``scores``: questions by items; minus infinity where an item is none of a question's."""
        if not scores.size:
            return
        near = scores >= self.least[:, None] - 1e-9
        if not self._full:
            near &= scores > -np.inf
        if scores.shape[1] > self.k and np.count_nonzero(near) > 4 * self.k * self.n:
            cut = scores.shape[1] - self.k
            near &= scores >= np.partition(scores, cut, axis=1)[:, cut][:, None] - 2e-9
        q, at = np.divmod(np.flatnonzero(near), scores.shape[1])
        if not len(q):
            return
        self._waiting.append([q, scores[q, at], *(i[at] for i in ids)])
        self._rows += len(q)
        if not self._full or self._rows > self.k * self.n:
            self._merge()

    def _merge(self) -> None:
        if not self._waiting:
            return
        every = [np.concatenate(c) for c in zip(self._held, *self._waiting, strict=True)]
        self._waiting, self._rows = [], 0
        places = np.round(every[1], 9)
        order = np.lexsort((*every[:1:-1], -places, every[0]))
        q = every[0][order]
        first = np.searchsorted(q, np.arange(self.n))
        keep = np.arange(len(q)) - first[q] < self.k
        self._held = [c[order[keep]] for c in every]
        count = np.bincount(self._held[0], minlength=self.n)
        last = np.cumsum(count)[count == self.k] - 1
        self.least[count == self.k] = np.round(self._held[1][last], 9)
        self._full = bool((count == self.k).all())


class _Scan:
    """Questions of one key and length, and the k nearest of the vectors that pass by, ROWS questions at a time."""

    def __init__(self, who: np.ndarray, x: np.ndarray, k: int, same: bool, ids: int) -> None:
        order = np.argsort(who, kind="stable")
        self.who, self.x, self.same = who[order], x[order], same
        self.kept = [Kept(min(ROWS, len(x) - a), k, ids) for a in range(0, len(x), ROWS)]

    def add(self, y: np.ndarray, ids: list[np.ndarray]) -> None:
        for a in range(0, len(y), COLUMNS):
            some, names = y[a : a + COLUMNS], [i[a : a + COLUMNS] for i in ids]
            # Where the questions' own vectors are among these.
            first, past = (np.searchsorted(self.who, names[0], side) for side in ("left", "right"))
            own = [] if self.same else [(q, j) for j in np.flatnonzero(first < past) for q in range(first[j], past[j])]
            at = np.array(own, np.int64).reshape(-1, 2)
            for k, kept in enumerate(self.kept):
                scores = self.x[k * ROWS : (k + 1) * ROWS] @ some.T
                mine = at[at[:, 0] // ROWS == k]
                scores[mine[:, 0] % ROWS, mine[:, 1]] = -np.inf
                kept.add(scores, names)

    def rows(self) -> Iterator[list[np.ndarray]]:
        for k, kept in enumerate(self.kept):
            q, score, *ids = kept.held
            yield [self.who[k * ROWS + q], *ids, score]


def _scan(k: int, same: bool, ids: tuple[str, ...]):
    def scan(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        """Best k of a block of vectors, all of one length, for each query of a block."""
        stack = lambda t: np.stack([np.asarray(v, np.float64) for v in t.column("v").to_numpy(zero_copy_only=False)])
        one = _Scan(queries.column("q").to_numpy(), stack(queries), k, same, len(ids))
        one.add(stack(vectors), [vectors.column(c).to_numpy() for c in ids])
        return pa.table([np.concatenate(c) for c in zip(*one.rows(), strict=True)], names=["q", *ids, "score"])

    return scan


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """((key, length), places, vectors) of a batch's rows that have both."""
    named, v = batch.column("key").dictionary_encode(), batch.column("v")
    code = pc.fill_null(named.indices, -1).to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(v.value_lengths(), 0).to_numpy(zero_copy_only=False)
    for c, d in np.unique(np.stack([code, lengths]), axis=1).T.tolist():
        if c >= 0 and d > 0:
            at = np.flatnonzero((code == c) & (lengths == d))
            yield (named.dictionary[c].as_py(), d), at, v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, same: bool = False, block: int = BLOCK, ids: tuple[str, ...] = ("doc",)) -> DataFrame:
    """(q, ids, score, rank): the k largest cosines of unit vectors, exactly; ties to the smaller id.

    ``queries``: (q, v, key), ``vectors``: (ids, v, key); only equal keys and lengths meet,
    and unless ``same`` a query does not meet its own (first) id. A task holds a block of
    queries, of at most about ``block``, while all vectors pass by, and keeps k for each:
    queries and results are dealt once, vectors once a block.
    """
    spark = queries.sparkSession
    scratch.prepare(spark)
    n = queries.count()
    blocks = max(1, -(-n // block), min(spark.sparkContext.defaultParallelism, -(-n // LEAST)))
    none = [F.lit(None).cast(vectors.schema[c].dataType).alias(c) for c in ids]
    asked = queries.select(F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("_b"), F.lit(True).alias("asks"), F.col("q").cast("long").alias("q"), *none, "v", "key")
    every = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), F.lit(False).alias("asks"), F.lit(None).cast("long").alias("q"), *ids, "v", "key")
    dealt = asked.unionByName(every).repartitionById(blocks, F.col("_b")).sortWithinPartitions(F.desc("asks"))
    types = {"bigint": pa.int64(), "int": pa.int32()}
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ids}
    schema = pa.schema([("q", pa.int64()), *((c, types[t]) for c, t in kinds.items()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, scans = {}, None
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            for side in (True, False):
                some = batch.filter(pa.array(asks == side))
                if some.num_rows and not side and scans is None:
                    scans = {g: _Scan(np.concatenate(q), np.concatenate(x), k, same, len(ids)) for g, (q, x) in held.items()}
                names = [some.column(c).to_numpy(zero_copy_only=False) for c in (("q",) if side else ids)]
                for group, at, v in _groups(some):
                    if side:
                        q, x = held.setdefault(group, ([], []))
                        q.append(names[0][at].astype(np.int64))
                        x.append(v)
                    elif group in scans:
                        scans[group].add(v, [i[at] for i in names])
        for one in (scans or {}).values():
            for columns in one.rows():
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    ddl = ", ".join(["q long", *(f"{c} {t}" for c, t in kinds.items()), "score double"])
    found = dealt.drop("_b").mapInArrow(scan, ddl)
    return top(found, k, F.round("score", 9).desc(), *ids)


def fuse(lists: DataFrame, item: str = "doc", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (q, list, item, rank): score, best_rank; repeats keep their first place."""
    once = lists.groupBy("q", "list", item).agg(F.min("rank").alias("rank"))
    place = Window.partitionBy("q", "list").orderBy("rank")
    dense = once.withColumn("rank", F.row_number().over(place))
    return dense.groupBy("q", item).agg(F.sum(V.rrf(F.col("rank"), k)).alias("score"), F.min("rank").cast("long").alias("best_rank"))


def fused_order(item: str = "doc") -> tuple[Column, ...]:
    return F.round("score", 9).desc(), F.col("best_rank"), F.col(item)


def one_passage(chunk_lists: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Documents by document-level fusion, each with its best chunk by chunk-level fusion.

    ``chunk_lists``: (q, list, chunk, doc, rank); a chunk may be a struct. A document's
    place in a list is that of its first chunk there.
    """
    by_doc = fuse(chunk_lists.groupBy("q", "list", "doc").agg(F.min("rank").alias("rank")))
    by_chunk = fuse(chunk_lists, "chunk").join(chunk_lists.select("q", "chunk", "doc").distinct(), ["q", "chunk"])
    best = top(by_chunk, 1, *fused_order("chunk"), within=("q", "doc")).select("q", "doc", "chunk")
    return top(by_doc, limit, *fused_order()).join(best, ["q", "doc"])

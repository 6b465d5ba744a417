"""Nearest neighbours by inner product: vantage-point trees, one over shards and one in each.

Largest inner product becomes nearest Euclidean point by one more coordinate: with M the
largest norm, x turns into (x, sqrt(M^2 - |x|^2)) and a query, stretched to the norm M,
into (q, 0), and then |q - x|^2 = 2 M^2 - 2 q.x. A vantage-point tree over a sample cuts space into cells of
about one shard each (a cell that cannot be cut, such as one of equal distances, is several
shards by hash). Every vector falls into the cell of its path and is dealt to its shard once;
copies of a vector are one row before that. A shard builds its tree in numpy and serves its
queries together: each first descends to its own leaf, which gives it a radius, and then
every subtree that the triangle inequality cannot rule out within that radius is visited.
Queries go in two rounds: to their own cell, and with the radius found there to the other
cells that the triangle inequality cannot rule out. ``relax`` multiplies the radius in both
tests; at one nothing nearer is ever left out. A query whose list of nearest points ends in
a tie walks the shard's tree once more for all points as near. Scores of what is found are
recomputed on the original vectors in double precision, and shards' lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern import scratch
from quern.llm import memory

#: Vectors of a shard, about; queries of a block, about; vectors of a leaf; vectors of the sample for each shard, and in all.
SHARD, BLOCK, LEAF, SAMPLE, SAMPLE_MOST = 8192, 16384, 128, 16, 1 << 16
#: Room for rounding in distances, relative to the largest squared distance.
SLACK = 1e-9


class Tree:
    """A vantage-point tree over rows of ``points``; nodes are (vantage point, radius, inside, outside) or a leaf's rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 0) -> None:
        self.points, self.leaf = points, leaf
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        vantage = self.points[rows[self.rng.integers(len(rows))]]
        d = np.sqrt(((self.points[rows] - vantage) ** 2).sum(axis=1))
        order = np.argpartition(d, len(rows) // 2)
        inner, outer = order[: len(rows) // 2], order[len(rows) // 2 :]
        # Bounds of both halves prune better than the radius alone, and hold for ties.
        bounds = (d[inner].min(), d[inner].max(), d[outer].min(), d[outer].max())
        return vantage, bounds, self._build(rows[inner]), self._build(rows[outer])

    def search(self, queries: np.ndarray, k: int, relax: float = 1.0, limit: np.ndarray | float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(squared distances, rows) of k nearest of each query, unordered; -1 where there are fewer, or those left are farther than ``limit``."""
        self.q, self.k, self.relax, self.limit = queries, k, relax, np.broadcast_to(limit, len(queries))
        self.q2, self.p2 = (queries**2).sum(axis=1), (self.points**2).sum(axis=1)
        self.slack = SLACK * (1 + self.q2.max(initial=0) + self.p2.max(initial=0))
        self.best = np.full((len(queries), k), np.inf)
        self.rows = np.full((len(queries), k), -1)
        self.seen = np.full(len(queries), -1)
        self._descend(self.root, np.arange(len(queries)), [0])
        self._walk(self.root, np.arange(len(queries)), [0])
        return self.best, self.rows

    def within(self, i: int, limit: float) -> np.ndarray:
        """All rows whose squared distance from query ``i`` of the last search is at most ``limit``, but for rounding."""
        who, radius, out, open_ = np.array([i]), np.sqrt(max(limit, 0) + self.slack) + np.sqrt(self.slack), [], [self.root]
        while open_:
            node = open_.pop()
            if isinstance(node, np.ndarray):
                d = self.q2[i] + self.p2[node] - 2 * (self.points[node] @ self.q[i])
                out.append(node[d <= limit + self.slack])
                continue
            vantage, bounds, inner, outer = node
            d = self._distance(vantage, who)[0]
            open_.extend(child for child, low, high in ((inner, *bounds[:2]), (outer, *bounds[2:])) if max(low - d, d - high) <= radius)
        return np.concatenate(out)

    def _scan(self, rows: np.ndarray, who: np.ndarray) -> None:
        d = self.q2[who, None] + self.p2[rows][None, :] - 2 * (self.q[who] @ self.points[rows].T)
        hit = (d < self.best[who].max(axis=1)[:, None]).any(axis=1)
        if not hit.any():
            return
        who, d = who[hit], d[hit]
        both = np.concatenate([self.best[who], d], axis=1)
        names = np.concatenate([self.rows[who], np.broadcast_to(rows, d.shape)], axis=1)
        keep = np.argpartition(both, self.k - 1, axis=1)[:, : self.k]
        self.best[who] = np.take_along_axis(both, keep, axis=1)
        self.rows[who] = np.take_along_axis(names, keep, axis=1)

    def _descend(self, node, who: np.ndarray, number: list[int]) -> None:
        """The leaf whose side each query falls on."""
        if isinstance(node, np.ndarray):
            if len(who) and len(node):
                self._scan(node, who)
                self.seen[who] = number[0]
            number[0] += 1
            return
        vantage, (_, high, low, _), inner, outer = node
        d = self._distance(vantage, who)
        self._descend(inner, who[d <= (high + low) / 2], number)
        self._descend(outer, who[d > (high + low) / 2], number)

    def _distance(self, vantage: np.ndarray, who: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.q2[who] + vantage @ vantage - 2 * (self.q[who] @ vantage), 0))

    def _walk(self, node, who: np.ndarray, number: list[int]) -> None:
        if isinstance(node, np.ndarray):
            who = who[self.seen[who] != number[0]]
            if len(who) and len(node):
                self._scan(node, who)
            number[0] += 1
            return
        vantage, bounds, inner, outer = node
        d = self._distance(vantage, who)
        for child, low, high in ((inner, *bounds[:2]), (outer, *bounds[2:])):
            radius = self.relax * np.sqrt(np.maximum(np.minimum(self.best[who].max(axis=1), self.limit[who]), 0) + self.slack)
            gap = np.maximum(low - d, d - high)
            self._walk(child, who[gap <= radius + np.sqrt(self.slack)], number)


class Cells:
    """A vantage-point tree whose leaves are cells of space, numbered from ``first``; built from a sample, it places any point."""

    def __init__(self, sample: np.ndarray, leaves: int, first: int = 0, seed: int = 0) -> None:
        self.rng, self.count = np.random.default_rng(seed), first
        self.root = self._build(sample, leaves)

    def _build(self, points: np.ndarray, leaves: int):
        if leaves > 1 and len(points) > 1:
            vantage = points[self.rng.integers(len(points))]
            d = np.sqrt(((points - vantage) ** 2).sum(axis=1))
            inside = d <= np.median(d)
            if not inside.all():
                # What all points of a cell keep to is the radius alone, as they are not those of the sample.
                return vantage, float(np.median(d)), self._build(points[inside], leaves - leaves // 2), self._build(points[~inside], leaves // 2)
        self.count += 1
        return self.count - 1

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.empty(len(x), np.int32)
        open_ = [(self.root, np.arange(len(x)))]
        while open_:
            node, who = open_.pop()
            if isinstance(node, int):
                out[who] = node
                continue
            vantage, radius, inner, outer = node
            inside = np.sqrt(((x[who] - vantage) ** 2).sum(axis=1)) <= radius
            open_ += [(inner, who[inside]), (outer, who[~inside])]
        return out

    def near(self, q: np.ndarray, reach: np.ndarray) -> list[np.ndarray]:
        """For each query the cells that may hold a point within ``reach`` of it."""
        pairs = []
        open_ = [(self.root, np.arange(len(q)))]
        while open_:
            node, who = open_.pop()
            if isinstance(node, int):
                pairs.append((np.full(len(who), node, np.int32), who))
                continue
            vantage, radius, inner, outer = node
            d = np.sqrt(((q[who] - vantage) ** 2).sum(axis=1))
            open_ += [(inner, who[d - reach[who] <= radius]), (outer, who[d + reach[who] >= radius])]
        cell, who = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order = np.argsort(who, kind="stable")
        return np.split(cell[order], np.searchsorted(who[order], np.arange(1, len(q))))


@dataclass(frozen=True)
class Space:
    """Vectors of one length: the largest squared norm and the cells."""

    top: float
    cells: Cells

    def raised(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(self.top - (x**2).sum(axis=1), 0))]


def _stretched(q: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """(queries as points at the squared norm ``top``, what their scores are multiplied by)."""
    scale = np.sqrt(top / (q**2).sum(axis=1))
    return np.c_[q * scale[:, None], np.zeros(len(q))], scale


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column.to_numpy(zero_copy_only=False)]) if len(column) else np.zeros((0, 0))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch by the length of their vectors."""
    d = batch.column("d").to_numpy()
    for n in np.unique(d).tolist():
        yield n, batch.filter(pa.array(d == n))


def _placer(spaces: dict[int, Space], queries: bool):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cell of each vector."""
        for batch in batches:
            for n, part in _by_length(batch):
                x = _matrix(part.column("v"))
                x = _stretched(x, spaces[n].top)[0] if queries else spaces[n].raised(x)
                yield part.append_column("cell", pa.array(spaces[n].cells.of(x), pa.int32()))

    return place


def _router(spaces: dict[int, Space], relax: float):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells beside its own that each query has to ask, by the worst score that it holds."""
        for batch in batches:
            for n, part in _by_length(batch):
                q = _matrix(part.column("v"))
                least = part.column("least").to_numpy()
                space = spaces[n]
                q, scale = _stretched(q, space.top)
                slack = SLACK * (1 + 2 * space.top)
                reach = relax * np.sqrt(np.maximum(2 * space.top - 2 * least * scale, 0) + slack) + np.sqrt(slack)
                cells = space.cells.near(q, reach)
                own = part.column("cell").to_numpy()
                others = [c[c != o] for c, o in zip(cells, own, strict=True)]
                at = np.repeat(np.arange(len(others)), [len(c) for c in others])
                out = part.take(pa.array(at))
                yield out.set_column(out.schema.get_field_index("cell"), "cell", pa.array(np.concatenate(others), pa.int32()))

    return route


def _searcher(k: int, relax: float, leaf: int):
    @memory.tidy_pair
    def search(points: pa.Table, queries: pa.Table) -> pa.Table:
        """Each query's best k of the shard, the query itself aside; ties to the smaller id."""
        out: tuple[list, list, list, list] = ([], [], [], [])
        if points.num_rows and queries.num_rows:
            x, q = _matrix(points.column("v")), _matrix(queries.column("v"))
            held = points.column("ids").combine_chunks()
            who, version, least = (queries.column(c).to_numpy() for c in ("query_id", "version", "least"))
            # Equal vectors are one point of the tree with their ids in order, each once.
            distinct, kind = np.unique(x, axis=0, return_inverse=True)
            kind = np.repeat(kind.reshape(-1), held.value_lengths().to_numpy())
            ids = held.flatten().to_numpy()
            order = np.lexsort((ids, kind))
            kind, ids = kind[order], ids[order]
            new = np.r_[True, (kind[1:] != kind[:-1]) | (ids[1:] != ids[:-1])]
            kind, ids = kind[new], ids[new]
            starts = np.searchsorted(kind, np.arange(len(distinct) + 1))
            norm2 = (distinct**2).sum(axis=1)
            top = norm2.max()
            stretched, scale = _stretched(q, top)
            # One more for the query itself, and some for points whose distances round to a tie.
            wide = min(len(distinct), k + 9)
            tree = Tree(np.c_[distinct, np.sqrt(np.maximum(top - norm2, 0))], leaf)
            best, rows = tree.search(stretched, wide, relax, 2 * top - 2 * least * scale)
            # Where the last of the list ties with the last that can be picked, points left out may tie too.
            last = np.sort(best, axis=1)[:, min(k, wide - 1)]
            tied = np.isfinite(last) & (best.max(axis=1) <= last + 2 * tree.slack) & (wide < len(distinct))
            for i in range(len(q)):
                r = tree.within(i, last[i] + tree.slack) if tied[i] else rows[i][rows[i] >= 0]
                score = np.zeros(len(r))
                for x_j, q_j in zip(distinct[r].T, q[i], strict=True):  # in the order of components, so that equal vectors score alike
                    score += x_j * q_j
                # The first k + 1 ids of each point hold all that can be picked.
                size = np.minimum(starts[r + 1] - starts[r], k + 1)
                at = np.repeat(starts[r] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                own, value = ids[at], np.repeat(score, size)
                pick = np.lexsort((own, -value))
                pick = pick[own[pick] != who[i]][:k]
                out[0].extend([int(who[i])] * len(pick))
                out[1].extend([int(version[i])] * len(pick))
                out[2].extend(own[pick].tolist())
                out[3].extend(value[pick].tolist())
        return pa.table({c: pa.array(o, t) for c, o, t in zip(("query_id", "version", "vec_id", "score"), out, (pa.int64(),) * 3 + (pa.float64(),), strict=True)})

    return search


def _spaces(points: DataFrame, shard: int) -> dict[int, Space]:
    """Cells for each length of vectors: a row a length and a sample of vectors, SAMPLE_MOST at most of a length, reach the driver."""
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = points.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("top")).collect()
    out, first = {}, 0
    for row in sorted(sizes):
        leaves = -(-row["n"] // shard)
        sample = np.zeros((0, row["d"]))
        if leaves > 1:
            every = max(1, row["n"] // min(SAMPLE * leaves, SAMPLE_MOST // 2))
            picked = points.where(f"d = {row['d']}").where(F.pmod(F.xxhash64("v", F.lit(3)), F.lit(every)) == 0).select("v").limit(SAMPLE_MOST)
            sample = _matrix(picked.toArrow().column("v"))
        space = Space(row["top"], Cells(np.zeros((0, row["d"] + 1)), 1, first))
        space = Space(row["top"], Cells(space.raised(sample), leaves, first)) if len(sample) else space
        out[row["d"]], first = space, space.cells.count
    return out


def _meet(points: DataFrame, queries: DataFrame, shards: DataFrame, block: int, search) -> DataFrame:
    """Search in every shard of the cells that queries ask; a shard with many queries serves them in blocks."""
    asked = queries.join(F.broadcast(shards), "cell").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.first("shards") / block).cast("int").alias("blocks"))
    blocks = asked.sparkSession.createDataFrame([tuple(r) for r in blocks.collect()], "cell int, blocks int")  # a row a cell
    held = points.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("query_id", "version"), F.col("blocks")).cast("int"))
    keys = ("cell", "shard", "block")
    pair = held.select(*keys, "ids", "v").groupBy(*keys).cogroup(asked.select(*(F.col(c).alias(c) for c in (*keys, "query_id", "version", "v", "least"))).groupBy(*keys))
    return pair.applyInArrow(search, "query_id long, version long, vec_id long, score double")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, relax: float = 1.0, shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows
    but the query's own. Vectors (``embedding``) that are null, zero, empty or hold null
    or non-finite components, and rows with a null vec_id, take no part; vectors of another
    length than the query's are compared with none of it. Ties go to the smaller vec_id. A
    vec_id on several rows with equal vectors counts once; with different vectors each is a
    candidate, and each a query with ranks of its own. ``relax`` below one trades recall for
    speed. Other columns are not read. An empty table gives no rows.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    v = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("d"))
    # Copies of a vector are few rows with the first ids of each; salts bound what one group gathers.
    salts = max(1, -(-vectors.count() // shard))
    points = v.groupBy("d", "v", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt")).agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1).alias("ids")).drop("salt")
    points = scratch.save(points, "points")
    spaces = _spaces(points, shard)
    schema = "d int, v array<double>, ids array<long>"
    placed = points.mapInArrow(_placer(spaces, queries=False), f"{schema}, cell int")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * shard)).cast("int").alias("shards")).collect()
    shards = v.sparkSession.createDataFrame([tuple(r) for r in sizes], "cell int, shards int")  # a row a cell
    placed = placed.join(F.broadcast(shards), "cell").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    asked = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("version"), F.col("v").alias("v"), F.col("d").alias("d")).dropDuplicates(["query_id", "version"])
    home = scratch.save(asked.mapInArrow(_placer(spaces, queries=True), "query_id long, version long, v array<double>, d int, cell int"), "queries")
    search = _searcher(k, relax, leaf)
    near = scratch.save(_meet(placed, home.withColumn("least", F.lit(float("-inf"))), shards, block, search), "near")
    worst = near.groupBy("query_id", "version").agg(F.when(F.count(F.lit(1)) >= k, F.sort_array(F.collect_list("score"), asc=False)[k - 1]).otherwise(float("-inf")).alias("least"))
    bound = home.join(worst, ["query_id", "version"], "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    beside = scratch.save(bound.mapInArrow(_router(spaces, relax), "query_id long, version long, v array<double>, d int, cell int, least double"), "routes")
    more = _meet(placed, beside, shards, block, search)
    best = Window.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id")
    return near.unionByName(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

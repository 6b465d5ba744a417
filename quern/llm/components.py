"""Connected components of a link table by repeated star contraction, all on executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import scratch
from quern.llm import memory


@memory.tidy
def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one batch: each node beside the smallest of its tree."""
    for batch in batches:
        ends = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        ids, at = np.unique(ends, return_inverse=True)
        parent = list(range(len(ids)))

        def find(x: int, parent: list[int] = parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in at.reshape(2, -1).T.tolist():
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        roots = np.array([find(x) for x in range(len(ids))], np.int64)
        moved = roots != np.arange(len(ids))
        if moved.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[roots[moved]])], ["u", "v"])


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step: neighbours hang on the smallest node near them.

    ``edges`` has u > v. The large star links the larger neighbours of a node to its
    minimum, the small star the smaller ones and the node itself.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if small:
        kept = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        kept = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a long, b long)``; component: its smallest node.

    Each batch is first contracted by union-find; then large and small stars alternate
    (Kiveris et al., 2014) until nothing changes, in a logarithmic number of rounds. Every
    round is a written table, so a lost executor costs one round at most. No links: no rows.
    """
    edges = scratch.save(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().mapInArrow(_forest, "u long, v long").distinct(),
        "links",
    )
    check = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = check(edges)
    while seen[0]:
        after = scratch.save(_star(_star(edges, small=False), small=True), "links")
        scratch.drop(edges)
        edges, before, seen = after, seen, check(after)
        if before == seen:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

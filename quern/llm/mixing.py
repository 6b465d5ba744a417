"""Temperature mixing: source shares raised to a power, realised as block permutations.

Shares p of the sources' tokens become weights w proportional to p ** alpha. The exponent is
bisected until the weights' entropy reaches a target, or until no source is repeated more
than a limit while none is read less than once. With a budget of tokens every source then
gets ``w * budget``: as many whole passes as fit, and one partial pass. Each pass is a
permutation of the source's blocks and of the rows inside each block, both by seeded
hashes, so a partial pass is a prefix of it; a row is in the prefix if the tokens before
it, found from block sums and sums inside its block, stay below the rest of the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import scratch

#: Sources that the driver may handle; more are an error, not a cut.
MAX_SOURCES = 100_000
#: Tokens of a block, about.
BLOCK_TOKENS = 1 << 21


def word_count(text: str = "text") -> Column:
    """Words (runs of characters other than space and controls 9 to 13); null: none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weights(tokens: dict[str | None, int], alpha: float) -> dict[str | None, float]:
    """Normalised p ** alpha of the sources that have tokens."""
    total = sum(tokens.values())
    raised = {s: (n / total) ** alpha for s, n in tokens.items() if n}
    norm = sum(raised.values())
    return {s: x / norm for s, x in raised.items()}


def entropy(w: dict[str | None, float]) -> float:
    return -sum(x * math.log(x) for x in w.values() if x)


def _bisect(holds, bad: float, good: float, steps: int = 60) -> float:
    """The exponent nearest to ``bad`` at which ``holds``; it holds at ``good``."""
    if holds(bad):
        return bad
    for _ in range(steps):
        mid = (bad + good) / 2
        bad, good = (bad, mid) if holds(mid) else (mid, good)
    return good


def exponent_for_entropy(tokens: dict[str | None, int], target: float) -> float:
    """Exponent in [0, 64] whose weights have at most ``target`` nats, as near as can be."""
    return _bisect(lambda a: entropy(weights(tokens, a)) <= target, 0.0, 64.0) if any(tokens.values()) else 1.0


def exponent_for_repetition(tokens: dict[str | None, int], limit: float) -> float:
    """Smallest exponent in [0, 1] at which no source is read over ``limit`` times as often as another."""

    def fits(a: float) -> bool:
        rate = [w / tokens[s] for s, w in weights(tokens, a).items()]
        return max(rate) <= limit * min(rate) * (1 + 1e-12)

    return _bisect(fits, 0.0, 1.0) if any(tokens.values()) else 1.0


def _draw(seed: int, what: str, *keys: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(what), *keys)


def mix_sources(docs: DataFrame, max_repetition: float | None = 1.25, target_entropy: float | None = None, budget: int | None = None, seed: int = 0) -> DataFrame:
    """``docs`` with _epoch, _block_at, _at: one row for each time a document is read.

    Without ``budget`` it is the least with which every source is read at least once, so
    no document is lost. The sources' sums (at most MAX_SOURCES) are what the driver sees;
    texts are never shuffled. Sorting a source by (_epoch, _block_at, _at) gives its
    reading order. A null source is a source. A document without words weighs one token.
    A partial pass takes a row if its tokens begin inside the budget, so a source overshoots
    its share by less than one document; rows with the same doc_id and text are taken
    together. The three columns replace any of the same names. An empty table gives no rows.
    """
    kept = docs.drop("_epoch", "_block_at", "_at")
    spark = docs.sparkSession
    # The row goes along as one value, so its names clash with none; keys of a row inside its block, for the partial pass.
    keys = {"_h": _draw(seed, "block", "doc_id"), "_at": _draw(seed, "row", "doc_id", F.xxhash64("text"))}
    keyed = kept.select(F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("_row"), F.col("source").cast("string").alias("source"), *(k.alias(c) for c, k in keys.items()))
    narrow = scratch.save(kept.select(F.col("source").cast("string").alias("source"), *(k.alias(c) for c, k in keys.items()), F.greatest(word_count(), F.lit(1).cast("long")).alias("n")), "mixing")
    sums = narrow.groupBy("source").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = {r["source"]: r["n"] for r in sums}
    if not tokens:
        return keyed.withColumns({"_epoch": F.lit(0), "_block_at": F.lit(0).cast("long")}).select("_row.*", "_epoch", "_block_at", "_at")
    alpha = exponent_for_entropy(tokens, target_entropy) if target_entropy is not None else exponent_for_repetition(tokens, max_repetition or 1.0)
    w = weights(tokens, alpha)
    budget = budget if budget is not None else max(tokens[s] / w[s] for s in w)
    reads = {s: budget * w[s] / tokens[s] for s in w}
    reads = {s: round(r) if abs(r - round(r)) < 1e-9 else r for s, r in reads.items()}
    rest = {s: (r - int(r)) * tokens[s] for s, r in reads.items()}
    quota = [(s, int(reads[s]), float(rest[s]), max(1, tokens[s] // BLOCK_TOKENS)) for s in w]
    quotas = spark.createDataFrame(quota, "_s string, _whole int, _rest double, _blocks long")

    def with_quota(df: DataFrame) -> DataFrame:
        """A row of four numbers for each source is all that is broadcast."""
        placed = df.join(F.broadcast(quotas), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        return placed.withColumn("_block", F.pmod("_h", "_blocks"))

    partial = with_quota(narrow).where("_rest > 0").withColumn("_b", _draw(seed, "order", "_whole", "_block"))
    before = Window.partitionBy("source").orderBy("_b", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = partial.groupBy("source", "_rest", "_b", "_block").agg(F.sum("n").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    last = blocks.where("_before < _rest and _before + n >= _rest").select(F.col("source").alias("_s"), F.col("_block").alias("_cut"), F.col("_b").alias("_cut_b"), F.col("_before").cast("double").alias("_from"))
    last = spark.createDataFrame([tuple(r) for r in last.collect()], "_s string, _cut long, _cut_b long, _from double")  # one row a source
    inside = Window.partitionBy("source").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    own = partial.join(F.broadcast(last), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_cut")))
    upto = own.withColumn("_run", F.col("_from") + F.coalesce(F.sum("n").over(inside), F.lit(0))).where("_run < _rest").groupBy("source").agg(F.max("_at").alias("_upto"))
    upto = {r["source"]: r["_upto"] for r in upto.collect()}  # one row a source
    cuts = spark.createDataFrame([(r["_s"], r["_cut"], r["_cut_b"], upto[r["_s"]]) for r in last.collect()], "_s string, _cut long, _cut_b long, _upto long")
    scratch.drop(narrow)

    placed = with_quota(keyed).join(F.broadcast(cuts), F.col("source").eqNullSafe(F.col("_s")), "left")
    b = _draw(seed, "order", "_whole", "_block")
    earlier = (b < F.col("_cut_b")) | ((b == F.col("_cut_b")) & (F.col("_block") < F.col("_cut")))
    in_part = F.coalesce(earlier | ((F.col("_block") == F.col("_cut")) & (F.col("_at") <= F.col("_upto"))), F.lit(False))
    times = F.col("_whole") + in_part.cast("int")
    out = placed.withColumn("_n", times).where("_n > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return out.withColumn("_block_at", _draw(seed, "order", "_epoch", "_block")).select("_row.*", "_epoch", "_block_at", "_at")

"""I-Match fingerprints with randomised lexicons.

The lexicon holds the terms (words, with A to Z lower-cased) whose
inverse document frequency lies in a band; document frequencies are counted over all
documents. A document's distinct lexicon terms are sorted and hashed once for the full
lexicon and once for each of several random subsets of it. Subsets keep terms at rates that
halve from level to level, so some fit short documents and some long ones; a subset of
which a document holds nothing gives it no hash. The likeness of two fingerprints is the
share of agreeing hashes among the places where either has one. A document with terms but
none of the lexicon gets one hash, of all its distinct terms, in the full lexicon's place.

The band's lower frequency bound is a share of all documents, so the lexicon has at most
(mean distinct terms of a document) / MIN_SHARE terms, however many documents there are;
that is what is shipped to the executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import memory, words

#: Document frequency of a lexicon term, as shares of all documents: idf between ln(1/0.2) and ln(1/0.0005).
MIN_SHARE, MAX_SHARE = 0.0005, 0.2
#: Levels of subsets (level l keeps a term with probability 2**-l) and subsets of a level.
LEVELS, EACH = 12, 12
#: Documents whose texts a task holds as strings at once.
ROWS = 1000
#: Added to the number of a range for the document that only follows it.
FOLLOWS = 1 << 30

_U = np.uint64
_SEEN = "term long, n long"


def _per_document(w: words.Words) -> list[np.ndarray]:
    """Sorted distinct term hashes of each document."""
    doc = w.doc
    order = np.lexsort((w.hashes, doc))
    h, d = w.hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return np.split(h, np.searchsorted(d, np.arange(1, len(w.first) - 1))) if len(w.first) > 1 else []


@memory.tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a task hold each term."""

    def parts() -> Iterator[np.ndarray]:
        for batch in batches:
            data, offsets = words.buffers(batch.column("text"))
            for i, j in words.chunks(offsets):
                yield from _per_document(words.split(data, offsets[i : j + 1], lower=True))

    for term, n in words.tally(parts()):
        yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], ["term", "n"])


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> np.ndarray:
    """Sorted hashes of the terms whose document frequency lies in the band (at least two documents)."""
    total = docs.count()
    counts = docs.select("text").mapInArrow(_count, _SEEN).groupBy("term").agg(F.sum("n").alias("df"))
    band = counts.where((F.col("df") >= max(2.0, min_share * total)) & (F.col("df") <= max(2.0, max_share * total)))
    found = band.select("term").toArrow().column("term").to_numpy() if total else np.zeros(0, np.int64)
    return np.sort(found.view(_U))


def signatures(terms: np.ndarray, known: np.ndarray, levels: int = LEVELS, each: int = EACH) -> np.ndarray:
    """32-bit hash of each subset's terms of one document: the full lexicon first (all terms if it holds none); zero where it holds none."""
    every = terms
    if len(known):
        at = np.searchsorted(known, terms)
        at[at == len(known)] = 0
        terms = terms[known[at] == terms]
    else:
        terms = terms[:0]
    out = np.zeros(1 + (levels - 1) * each, _U)
    if not len(terms):
        if len(every):
            out[0] = words.mix(words.mix(every + _U(2)).sum(keepdims=True))[0] >> _U(32) | _U(1)
        return out
    # Sums over sorted distinct terms, each mixed anew for its subset, stand for the hash of their list.
    out[0] = words.mix(words.mix(terms + _U(1)).sum(keepdims=True))[0] >> _U(32) | _U(1)
    place = 1
    draw = words.mix(terms[None, :] + words.mix(np.arange(1, each + 1, dtype=_U))[:, None])
    value = words.mix(draw + _U(0x632BE59BD9B4E019))
    zeros = 64 - np.frexp((draw >> _U(1)).astype(np.float64))[1] - 1  # leading zeros decide the deepest level
    for level in range(1, levels):
        inside = zeros >= level
        total = np.where(inside, value, _U(0)).sum(axis=1)
        out[place : place + each] = np.where(inside.any(axis=1), words.mix(total + _U(level)) >> _U(32) | _U(1), _U(0))
        place += each
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal hashes among places where either has one; two empty fingerprints are alike."""
    either = (a != 0) | (b != 0)
    return float(((a == b) & either).sum() / either.sum()) if either.any() else 1.0


def text_form(sig: np.ndarray) -> str:
    """Fingerprint as hexadecimal digits: four bytes of each hash."""
    return sig.astype(">u4").tobytes().hex()


def _of(texts: list[bytes], known: np.ndarray) -> list[np.ndarray]:
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    out = []
    for i, j in words.chunks(offsets):
        out.extend(signatures(t, known) for t in _per_document(words.split(data, offsets[i : j + 1], lower=True)))
    return out


def edited(text: str, following: str) -> str:
    """``text`` whose last half gives way to as much of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walker(known: np.ndarray):
    """An extra row ends its part: it is the first of the next, and only there to follow."""

    @memory.tidy
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document that waits for the next
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            raw = [t.encode() for t in texts]
            part, ids, extra = (batch.column(c).to_pylist() for c in ("part", "doc_id", "extra"))
            sig = _of(raw, known)
            pairs = []
            for i in range(len(texts)):
                if held is not None and held[0] == part[i]:
                    pairs.append((held, (texts[i], sig[i])))
                held = None if extra[i] else (part[i], ids[i], texts[i], sig[i])
            changed = [edited(a[2], b[0]) for a, b in pairs]
            changed_raw = [t.encode() for t in changed]
            after = _of(changed_raw, known)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[1] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in changed_raw], pa.string()),
                    pa.array([text_form(a[3]) for a, _ in pairs], pa.string()),
                    pa.array([text_form(s) for s in after], pa.string()),
                    pa.array([likeness(a[3], s) for (a, _), s in zip(pairs, after, strict=True)], pa.float64()),
                    pa.array([likeness(a[3], b[1]) for a, b in pairs], pa.float64()),
                ],
                _RESULT.replace(" long", "").replace(" string", "").replace(" double", "").split(", "),
            )

    return walk


#: Bytes of text in a range of documents, about, and documents of the sample for each bound.
PART_BYTES, SAMPLE = 8 << 20, 16
#: Ranges at most: bounds and sample stay a few MB on the driver and in a task; beyond 80 GB ranges are larger instead, and are walked a batch at a time all the same.
MOST_PARTS = 10_000


def _part_of(bounds: np.ndarray) -> Column:
    """Of keys (k, t): the range that a row lies in, and for a row that opens a range also the one before, else -1.

    ``bounds`` has rows (k, t) in order, the first of them the smallest of the table.
    """
    low, n = bounds[:, 0], len(bounds)

    def place(k: pd.Series, t: pd.Series) -> pd.DataFrame:
        k, t = k.to_numpy(np.int64), t.to_numpy(np.int64)
        first, after = np.searchsorted(low, k, "left"), np.searchsorted(low, k, "right")
        at = first - 1
        opens = np.zeros(len(k), bool)
        shared = np.flatnonzero(first < after)
        for a in np.unique(first[shared]):  # keys that are bounds: the second half decides
            rows = shared[first[shared] == a]
            own = bounds[a : after[rows[0]], 1]
            step = np.searchsorted(own, t[rows], "right")
            at[rows] += step
            opens[rows] = (step > 0) & (own[np.maximum(step, 1) - 1] == t[rows])
        return pd.DataFrame({"part": at.astype(np.int32), "before": np.where(opens, (at - 1) % n, -1).astype(np.int32)})

    return F.pandas_udf(place, "part int, before int")("k", "t")


def fingerprints_beside_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprint of each document, of its edited text, and their likenesses.

    The next document is the one with the next larger doc_id, the first one's after the
    last. Documents are ordered by (doc_id, hash of the text) and cut into ranges of about
    PART_BYTES, whose bounds are documents of a sample, SAMPLE for each; the document that
    opens a range is sent to the range before as well, so each range is walked in order by
    itself. Null text counts as empty. Rows that share a doc_id follow each other in the
    order of a hash of their texts, so many of them are many ranges too; rows that repeat
    id and text are one range. There are at most MOST_PARTS ranges. A null doc_id comes first. A lone document is its own next.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = lexicon(base)
    keyed = base.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("k"), F.xxhash64("text").alias("t"))
    whole = keyed.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("size"), F.min(F.struct("k", "t")).alias("least")).first()
    if not whole["rows"]:
        return spark.createDataFrame([], _RESULT)
    n = parts or min(MOST_PARTS, max(1, -(-whole["size"] // PART_BYTES)))
    # Two numbers of each document of the sample reach the driver: SAMPLE * n rows, about, and n is bounded.
    every = max(1, whole["rows"] // (SAMPLE * n))
    sample = keyed.select("k", "t").where(F.pmod(F.xxhash64("k", "t", F.lit(9)), F.lit(every)) == 0).distinct().toArrow() if n > 1 else None
    found = np.stack([c.to_numpy() for c in sample.columns], axis=1) if sample is not None else np.zeros((0, 2), np.int64)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    found = found[[i * len(found) // n for i in range(1, n)]] if len(found) else found
    bounds = np.unique(np.concatenate([np.array([tuple(whole["least"])], np.int64), found]), axis=0)
    placed = keyed.withColumn("p", _part_of(bounds)).withColumn("to", F.explode(F.when(F.col("p.before") < 0, F.array("p.part")).otherwise(F.array("p.part", F.col("p.before") + F.lit(FOLLOWS)))))
    rows = placed.select((F.col("to") % FOLLOWS).alias("part"), "doc_id", (F.col("to") >= FOLLOWS).alias("extra"), "text", "k", "t")
    # A range is a task: its number is the partition's, so nothing is sampled again.
    dealt = rows.repartitionById(len(bounds), "part").sortWithinPartitions("part", "extra", "k", "t")
    return dealt.select("part", "doc_id", "extra", "text").mapInArrow(_walker(known), _RESULT)

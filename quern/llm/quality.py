"""Compression classifier: two zstandard dictionaries and a calibrated score.

One dictionary is built from good labelled texts, one from bad. A text is compressed block
by block with either; the difference of the compressed sizes, divided by the text's size,
says which kind it resembles. A logistic curve over that difference, the good size and the
text's own compressed size (both divided likewise; repetition shows there) makes it a
probability, fitted on labelled texts that built no dictionary and weighted to the classes'
true shares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import memory, words

#: The bounded sample of training, as parameters of :func:`train`: labelled documents of a
#: class, and bytes of a text above which it is no candidate. With both, at most
#: 2 * 1200 * 32 KiB reach the driver. All bytes of a sampled text are used.
SAMPLE, SAMPLE_BYTES = 1200, 32 << 10
#: Texts of a class from which on halves of them build the dictionary and fit the curve.
FEW = 20
#: Bytes of a dictionary, of a block compressed with it, and zstandard's level.
DICT_BYTES, BLOCK, LEVEL = 64 << 10, 512, 3
SCORE = "_quality_score"


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    bias: float

    def scorer(self) -> Callable[[bytes], float]:
        features = _features(self.good, self.bad)
        w = np.array(self.weights)
        return lambda text: float(1 / (1 + np.exp(-np.clip(features(text) @ w + self.bias, -30, 30))))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = None
    if dictionary:
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def _features(good: bytes, bad: bytes) -> Callable[[bytes], np.ndarray]:
    like, unlike, plain = _compressor(good), _compressor(bad), _compressor(b"")

    def of(text: bytes) -> np.ndarray:
        a = b = 0
        for i in range(0, len(text), BLOCK):
            block = text[i : i + BLOCK]
            a += len(like.compress(block))
            b += len(unlike.compress(block))
        n = len(text) + 8
        return np.array([(b - a) / n, a / n, len(plain.compress(text)) / n])

    return of


def _evenly(blocks: list[bytes]) -> bytes:
    """Blocks joined by newlines; of more than DICT_BYTES only so many, at even steps over all of them."""
    if sum(map(len, blocks)) + len(blocks) > DICT_BYTES:
        blocks = [blocks[k] for k in np.linspace(0, len(blocks) - 1, DICT_BYTES // (BLOCK + 1)).astype(int)]
    return b"\n".join(blocks)


def _dictionary(texts: list[bytes]) -> bytes:
    """Trained by zstandard; where it finds too little to train on, the texts themselves, taken evenly."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return _evenly(blocks)


def _fitting(of: dict[int, list[bytes]], few: int) -> tuple[dict[int, bytes], dict[int, np.ndarray]]:
    """The dictionaries of both classes, and features of texts that built none of those they are measured with.

    From ``few`` texts of a class on one half builds and the other is measured; below, the
    dictionary is built of all and each text is measured with one of the others.
    """
    built = {q: _dictionary(t[::2] if len(t) >= few else t) for q, t in of.items()}
    x = {}
    for q, t in of.items():
        pair = lambda own, q=q: (own, built[0]) if q else (built[1], own)
        if len(t) >= few:
            measure = _features(*pair(built[q]))
            x[q] = np.array([measure(text) for text in t[1::2]])
        else:
            x[q] = np.array([_features(*pair(_dictionary(t[:k] + t[k + 1 :])))(text) for k, text in enumerate(t)])
    return built, x


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Newton's method on standardised columns, given back for the raw ones."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    b = np.zeros(a.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - penalty * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b[:-1] / scale, float(b[-1] - (b[:-1] * mean / scale).sum())


def held_out(doc_id: str = "doc_id") -> Column:
    """True where the CRC-32 of the id's digits leaves 1 when divided by three."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, few: int = FEW) -> Model:
    """Learn from labels(doc_id, quality) of documents that are not held out.

    A bounded sample in the order of a hash of doc_id is collected: of each class up to
    ``sample`` documents whose text has 1 to ``sample_bytes`` bytes. Labels of absent, null,
    empty or longer texts take no place in it, and a doc_id counts once. Without such texts
    of both classes every score is the share of good labels, or 0.5. A class of fewer than
    ``few`` sampled texts is fitted by leaving one out, a larger one by halves.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    share = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    fits = docs.where(F.octet_length("text").between(1, sample_bytes))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    # Ids alone are joined to the labels; no text is shuffled.
    usable = known.join(fits.select("doc_id"), "doc_id", "left_semi")
    picked = usable.where("quality = 1").orderBy(*order).limit(sample).unionByName(usable.where("quality = 0").orderBy(*order).limit(sample)).collect()
    quality = {r["doc_id"]: r["quality"] for r in picked}
    if not quality:
        return Model(b"", b"", (0.0, 0.0, 0.0), 0.0)
    # At most 2 * sample ids are broadcast.
    wanted = docs.sparkSession.createDataFrame([(i,) for i in quality], "doc_id long")
    texts = fits.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select(F.xxhash64("doc_id").alias("k"), "doc_id", "text").collect()
    texts = sorted((r["k"], r["doc_id"], r["text"].encode()) for r in texts)
    of = {q: [t for _, i, t in texts if quality[i] == q] for q in (0, 1)}
    rate = share.get(1, 0) / sum(share.values())
    if not of[0] or not of[1]:
        return Model(b"", b"", (0.0, 0.0, 0.0), float(np.log((rate + 0.01) / (1 - rate + 0.01))))
    built, x = _fitting(of, few)
    y = np.r_[np.ones(len(x[1])), np.zeros(len(x[0]))]
    w, b = _logistic(np.concatenate([x[1], x[0]]), y, np.where(y == 1, rate / len(x[1]), (1 - rate) / len(x[0])) * len(y))
    return Model(built[1], built[0], tuple(map(float, w)), b)


def _score(model: Model):
    @memory.tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            data, offsets = words.buffers(batch.column("text"))
            view = memoryview(data)
            found = [of(bytes(view[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, SCORE])

    return score


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a last column ``_quality_score``, 0 to 1; it replaces one of that name.

    Null text scores as empty; whole texts are compressed, however long; equal texts score
    alike. Rows are neither dropped nor shuffled.
    """
    kept = docs.drop(SCORE)
    return kept.mapInArrow(_score(model), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", {SCORE} double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5) of every document."""
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.5).cast("int").alias("predicted"))

"""Masked pseudo-likelihood: a bidirectional window network that predicts every word.

A word's neighbours on both sides are embedded and pass one hidden layer, which predicts
the word itself by a softmax in two levels: a group of words, then the word in its group,
both from the hidden layer. Its biases start from the counts of the whole corpus, so what
is trained is the departure from them. Everything is learnt from all documents: a first
pass counts words; then the corpus is gone through once in ROUNDS parts (by a hash of the
text). In a round each task starts from the same weights and takes Adagrad steps over every
word of its documents of that part; the tasks' weights are averaged by their numbers of
words, in levels, only the average reaches the driver, and the next round starts from it.

What the network tells apart is bounded (VOCABULARY words by count; the others in BUCKETS
by their last letters, which tell languages and word classes apart), so the model has a
fixed size of about 1.2 MB. The counts are not: those of all words stay a written table, and
a word without an id of its own is joined to its count there, so it gets its own share of
its bucket. A word that was never counted gets UNSEEN.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import scratch
from quern.llm import memory, words

#: Words with an id of their own, buckets for the others, groups of the softmax; a group has (VOCABULARY + BUCKETS) / GROUPS members.
VOCABULARY, BUCKETS, GROUPS = 8192, 1024, 96
#: Neighbours on each side, embedding and hidden sizes.
SIDE, DIM, HIDDEN = 2, 8, 24
#: Words of a step, Adagrad's rate, parts of the corpus between which weights are averaged.
STEP, RATE, ROUNDS = 8192, 0.2, 3
#: Occurrences that a word counts for which the corpus does not hold, and last bytes by which rare words are put in buckets.
UNSEEN, SUFFIX = 0.5, 3

_U = np.uint64
_N = VOCABULARY + BUCKETS
_EACH = _N // GROUPS


def _terms(w: words.Words) -> np.ndarray:
    """A number of each word: the bucket of its last letters in the low bits, a hash of the whole above."""
    from_ = np.maximum(w.ends - SUFFIX, w.starts)
    return (w.hashes & ~_U(BUCKETS - 1)) | (words.hash_ranges(w.data, from_, w.ends, 2) & _U(BUCKETS - 1))


@dataclass(frozen=True)
class Vocabulary:
    """Sorted terms with their ids, and for each id its place (group * _EACH + member), log share and those of its group and bucket.

    ``log_share`` is that of one occurrence in a bucket, 0 for a word of its own; ``start``
    has the output biases that reproduce the counts.
    """

    terms: np.ndarray
    ids: np.ndarray
    place: np.ndarray
    log_share: np.ndarray
    start: np.ndarray
    counts: DataFrame | None = None  # term, n of all words, written; stays with the driver

    def shipped(self) -> Vocabulary:
        """What tasks need of it."""
        return replace(self, counts=None)

    def of(self, h: np.ndarray) -> np.ndarray:
        other = (VOCABULARY + (h & _U(BUCKETS - 1)).astype(np.int64)).astype(np.int32)
        if not len(self.terms):
            return other
        at = np.searchsorted(self.terms, h)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == h, self.ids[at], other)


@memory.tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[np.ndarray]:
        for batch in batches:
            data, offsets = words.buffers(batch.column("text"))
            for i, j in words.chunks(offsets):
                yield _terms(words.split(data, offsets[i : j + 1]))

    for term, n in words.tally(parts()):
        yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], ["term", "n"])


def vocabulary_of(top: list[tuple[int, int]], buckets: dict[int, int]) -> Vocabulary:
    """From the most frequent words (term, n) and the numbers of words of each bucket, those included."""
    terms = np.array([t for t, _ in top], np.int64).view(_U)
    n = np.zeros(_N)
    n[: len(top)] = [x for _, x in top]
    for b, total in buckets.items():
        n[VOCABULARY + b] = total
    np.subtract.at(n, VOCABULARY + (terms & _U(BUCKETS - 1)).astype(np.int64), n[: len(top)])
    n += UNSEEN  # what was never counted can still be scored
    place = np.empty(_N, np.int64)
    place[np.argsort(-n, kind="stable")] = np.arange(_N)
    share = np.zeros(_N)
    share[VOCABULARY:] = -np.log(n[VOCABULARY:])
    member = np.empty(_N)
    member[place] = n
    group = member.reshape(GROUPS, _EACH).sum(axis=1)
    start = np.r_[np.log(group / group.sum()), (np.log(member.reshape(GROUPS, _EACH)) - np.log(group)[:, None]).reshape(-1)]
    order = np.argsort(terms)
    return Vocabulary(terms[order], order.astype(np.int32), place, share, start.astype(np.float32))


def count_vocabulary(docs: DataFrame) -> Vocabulary:
    """Words of all documents, counted in a written table; VOCABULARY + BUCKETS rows reach the driver."""
    counts = scratch.save(docs.select("text").mapInArrow(_count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "words")
    top = counts.orderBy(F.desc("n"), "term").limit(VOCABULARY).collect()
    bucket = F.col("term").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    buckets = {r["b"]: r["n"] for r in counts.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect()}
    return replace(vocabulary_of([(r["term"], r["n"]) for r in top], buckets), counts=counts)


class Network:
    """Embeddings, one hidden layer, groups and members; all weights are one flat float32 array."""

    SHAPES = ((_N + 1, DIM), (2 * SIDE * DIM, HIDDEN), (HIDDEN,), (HIDDEN + 1, GROUPS), (GROUPS, HIDDEN + 1, _EACH))
    SIZE = sum(int(np.prod(s)) for s in SHAPES)

    def __init__(self, flat: np.ndarray) -> None:
        self.flat = flat
        self.parts, at = [], 0
        for shape in self.SHAPES:
            n = int(np.prod(shape))
            self.parts.append(flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def fresh(cls, vocabulary: Vocabulary, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        net = cls(np.zeros(cls.SIZE, np.float32))
        for i, scale in ((0, 0.3), (1, (2 * SIDE * DIM) ** -0.5)):
            net.parts[i][:] = rng.normal(0, scale, net.parts[i].shape)
        net.parts[0][_N] = 0  # beyond the ends of a document
        net.parts[3][-1], net.parts[4][:, -1] = vocabulary.start[:GROUPS], vocabulary.start[GROUPS:].reshape(GROUPS, _EACH)
        return net

    def hidden(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs, and hidden values with a last column of ones."""
        e, w1, b1 = self.parts[:3]
        x = e[around].reshape(len(around), -1)
        h = np.ones((len(x), HIDDEN + 1), np.float32)
        np.tanh(x @ w1 + b1, out=h[:, :-1])
        return x, h

    def members(self, h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Member outputs of rows that are ordered by their group, and the (group, first row, past its last row)."""
        out = np.empty((len(h), _EACH), np.float32)
        cut = np.flatnonzero(np.diff(group, prepend=-1, append=-1)).tolist()
        runs = [(int(group[x]), x, y) for x, y in zip(cut, cut[1:], strict=False)]
        for g, x, y in runs:
            np.matmul(h[x:y], self.parts[4][g], out=out[x:y])
        return out, runs

    def log_words(self, around: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Log probability of the id at each place, from its neighbours."""
        order = np.argsort(place)
        group, member = place[order] // _EACH, place[order] % _EACH
        _, h = self.hidden(around[order])
        out = np.empty(len(place))
        out[order] = _log_softmax(h @ self.parts[3], group) + _log_softmax(self.members(h, group)[0], member)
        return out


def _exp(z: np.ndarray) -> np.ndarray:
    """Exponentials in place; outputs start from log shares and stay far from single precision's bounds, else rows are shifted."""
    if z.max(initial=0) > 60:
        z -= z.max(axis=1, keepdims=True)
    return np.exp(z, out=z)


def _log_softmax(z: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    z = _exp(z)
    return np.log(np.maximum(z[np.arange(len(z)), wanted], np.float32(1e-37)) / z.sum(axis=1))


def _around(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ids of the neighbours of each word; _N beyond its document."""
    n = len(ids)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((n, 2 * SIDE), _N, np.int32)
    for k, shift in enumerate([s for s in range(-SIDE, SIDE + 1) if s]):
        a, b = max(0, -shift), min(n, n - shift)
        if b > a:
            same = doc[a:b] == doc[a + shift : b + shift]
            out[a:b, k] = np.where(same, ids[a + shift : b + shift], _N)
    return out


def _softmax_error(z: np.ndarray, wanted: np.ndarray, n: int) -> np.ndarray:
    """What the probabilities have over those wanted, divided by ``n``; in place."""
    z = _exp(z)
    z *= (np.float32(1 / n) / z.sum(axis=1))[:, None]
    z[np.arange(len(z)), wanted] -= np.float32(1 / n)
    return z


class _Trainer:
    def __init__(self, flat: np.ndarray, place: np.ndarray) -> None:
        self.net, self.place = Network(flat.copy()), place
        self.squares = np.full(Network.SIZE, 1e-6, np.float32)
        self.grad = Network(np.empty(Network.SIZE, np.float32))
        self.seen = 0

    def step(self, around: np.ndarray, ids: np.ndarray) -> None:
        place = self.place[ids]
        order = np.argsort(place)
        around, place = around[order], place[order]
        group, n = place // _EACH, len(place)
        e, w1, _, wg, wm = self.net.parts
        grad = self.grad.parts
        self.grad.flat[:] = 0
        x, h = self.net.hidden(around)
        z = _softmax_error(h @ wg, group, n)
        out, runs = self.net.members(h, group)
        y = _softmax_error(out, place % _EACH, n)
        dh = z @ wg.T
        for g, a, b in runs:
            np.matmul(h[a:b].T, y[a:b], out=grad[4][g])
            dh[a:b] += y[a:b] @ wm[g].T
        dh = dh[:, :-1] * (1 - h[:, :-1] ** 2)
        dx = (dh @ w1.T).reshape(-1, DIM)
        at = around.reshape(-1).astype(np.int64)
        grad[0][:] = np.bincount((at[:, None] * DIM + np.arange(DIM)).reshape(-1), dx.reshape(-1), e.size).reshape(e.shape)
        grad[0][-1] = 0
        np.matmul(x.T, dh, out=grad[1])
        grad[2][:] = dh.sum(axis=0)
        np.matmul(h.T, z, out=grad[3])
        g = self.grad.flat
        self.squares += g * g
        g /= np.sqrt(self.squares)
        g *= RATE
        self.net.flat -= g
        self.seen += n


def _coded(batch: pa.RecordBatch, vocabulary: Vocabulary):
    data, offsets = words.buffers(batch.column("text"))
    for i, j in words.chunks(offsets):
        w = words.split(data, offsets[i : j + 1])
        terms = _terms(w)
        yield i, j, w, terms, vocabulary.of(terms)


#: Weights of a row of the averaging; rows of a task are cut so that no group grows with the model.
PIECE = 16384
_PIECES = "piece int, salt int, words double, weights binary"


def _train(vocabulary: Vocabulary, flat: np.ndarray):
    vocabulary = vocabulary.shipped()

    @memory.tidy
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass over the documents of a task; its weights once, at the end."""
        trainer, task = _Trainer(flat, vocabulary.place), 0
        around, ids = [], []
        held = 0
        for batch in batches:
            for _, _, w, _, own in _coded(batch, vocabulary):
                if len(own):
                    task ^= int(w.hashes[0] >> _U(33))
                around.append(_around(own, w.first))
                ids.append(own)
                held += len(own)
                if held >= 8 * STEP:
                    a, b = np.concatenate(around), np.concatenate(ids)
                    for k in range(0, len(b) - STEP + 1, STEP):
                        trainer.step(a[k : k + STEP], b[k : k + STEP])
                    rest = len(b) - len(b) % STEP
                    around, ids, held = [a[rest:]], [b[rest:]], len(b) - rest
        if held:
            a, b = np.concatenate(around), np.concatenate(ids)
            for k in range(0, len(b), STEP):
                trainer.step(a[k : k + STEP], b[k : k + STEP])
        if trainer.seen:
            cut = [trainer.net.flat[k : k + PIECE].tobytes() for k in range(0, Network.SIZE, PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([task % 1024] * len(cut), pa.int32()), pa.array([float(trainer.seen)] * len(cut)), pa.array(cut, pa.binary())], ["piece", "salt", "words", "weights"])

    return train


@memory.tidy_group
def _mean(table: pa.Table) -> pa.Table:
    """The weights' mean by numbers of words, of one piece."""
    total, out = 0.0, 0.0
    for n, raw in zip(table.column("words").to_pylist(), table.column("weights"), strict=True):
        out = out + n * np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64)
        total += n
    return pa.table({"piece": table.column("piece")[:1], "salt": table.column("salt")[:1], "words": pa.array([total]), "weights": pa.array([(out / total).astype(np.float32).tobytes()], pa.binary())})


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Flat weights after one pass over all documents in ``rounds`` parts; fresh ones if they hold no words."""
    flat = Network.fresh(vocabulary, seed).flat
    for r in range(rounds):
        part = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r)
        each = part.mapInArrow(_train(vocabulary, flat), _PIECES)
        # First within salts, so that a piece's group stays small with many tasks.
        means = each.groupBy("piece", "salt").applyInArrow(_mean, _PIECES).groupBy("piece").applyInArrow(_mean, _PIECES)
        rows = sorted((x["piece"], bytes(x["weights"])) for x in means.collect())  # one model
        if rows:
            flat = np.frombuffer(b"".join(x for _, x in rows), np.float32).copy()
    return flat


def _scores(vocabulary: Vocabulary, net: Network, batch: pa.RecordBatch):
    """Of chunks of documents: their first number, words, terms, log probabilities with one occurrence for each rare word, and which are rare."""
    for i, _, w, terms, own in _coded(batch, vocabulary):
        near, place = _around(own, w.first), vocabulary.place[own]
        log_p = np.concatenate([np.zeros(0), *(net.log_words(near[k : k + 8192], place[k : k + 8192]) for k in range(0, len(own), 8192))])
        yield i, w, terms, log_p + vocabulary.log_share[own], own >= VOCABULARY


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0.0, np.cumsum(values)][first])


def _scorer(vocabulary: Vocabulary, flat: np.ndarray):
    """Scores by the model alone: a rare word counts as never seen."""
    vocabulary = vocabulary.shipped()

    @memory.tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(flat)
        for batch in batches:
            n, total = [], []
            for _, w, _, log_p, rare in _scores(vocabulary, net, batch):
                n.append(np.diff(w.first))
                total.append(_sums(log_p + np.log(UNSEEN) * rare, w.first))
            n, total = (np.concatenate(x) if x else np.zeros(0) for x in (n, total))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(total.astype(np.float64)), pa.array(total / np.maximum(n, 1), pa.float64())], ["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return score


_PARTS = "row long, doc_id long, n long, log_prob double, term long"


def _part_scorer(vocabulary: Vocabulary, flat: np.ndarray):
    vocabulary = vocabulary.shipped()

    @memory.tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of each document (term is null), and one of each of its rare words."""
        net = Network(flat)
        for batch in batches:
            names = batch.column("row").to_numpy()
            for i, w, terms, log_p, rare in _scores(vocabulary, net, batch):
                n = len(w.first) - 1
                term = terms[rare].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[names[i : i + n], names[i + w.doc[rare]]]),
                        pa.concat_arrays([batch.column("doc_id").slice(i, n), pa.nulls(len(term), pa.int64())]),
                        pa.array(np.r_[np.diff(w.first), np.ones(len(term), np.int64)]),
                        pa.array(np.r_[_sums(log_p, w.first), np.zeros(len(term))]),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(term, pa.int64())]),
                    ],
                    ["row", "doc_id", "n", "log_prob", "term"],
                )

    return score


def score_documents(docs: DataFrame, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """doc_id, n_tokens, log_prob (natural, summed over words), mean_log_prob of every document.

    Every word of every whole text is predicted from both sides. A text that is null or
    has no words has n_tokens 0 and both scores 0. Repeated rows score alike but for
    single-precision rounding; a null doc_id stays null. An empty table gives no rows. The
    weights are means over tasks, so they depend on how the input is cut into them.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocabulary = count_vocabulary(base)
    flat = train(base, vocabulary, rounds, seed)
    return _scored(base, vocabulary, flat)


def _scored(base: DataFrame, vocabulary: Vocabulary, flat: np.ndarray) -> DataFrame:
    numbered = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # Written once, so that a row keeps its number: documents with what the model knows, and their rare words.
    parts = scratch.save(numbered.mapInArrow(_part_scorer(vocabulary, flat), _PARTS), "scores")
    rare = parts.where("term IS NOT NULL").select("row", "n", "term").join(vocabulary.counts.select("term", F.col("n").alias("of")), "term", "left")
    added = rare.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n"), (F.col("n") * F.log(F.coalesce("of", F.lit(UNSEEN)))).alias("log_prob"))
    both = parts.where("term IS NULL").select("row", "doc_id", "n", "log_prob").unionByName(added)
    whole = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum("log_prob").alias("log_prob"))
    return whole.select("doc_id", "n_tokens", "log_prob", (F.col("log_prob") / F.greatest("n_tokens", F.lit(1))).alias("mean_log_prob"))

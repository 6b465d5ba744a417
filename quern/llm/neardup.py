"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, components.

SuperMinHash (Ertl, 2017) gives each shingle its own random permutation of the signature's
places; at step j the shingle offers a value in [j, j + 1) to the j-th place of its
permutation. Once every place holds a value of a step so far, later steps cannot win and
the document stops. All shingles of a chunk of documents take a step together in numpy.

Documents with equal shingle sets collapse first, so a group of copies is one row
thereafter. A band's bucket pairs its documents with one leader only, the one that meets
most others over all bands, and verified links are contracted to components. Documents that
met the same leader and still lie in different components are then compared without making
a row of any pair: each is sent once, as what it lacks of the leader and what it adds to it,
and the exact intersections of a leader's followers are matrix products over those few
shingles, in blocks of bounded size; those in the leader's component meet only the rest.
Every two documents of a bucket share its leader, so no pair that shares a band is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import scratch
from quern.llm import memory, words
from quern.llm.components import components

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A pair at the threshold shares no band with probability (1 - 0.75**4)**32 = 5e-6.
BANDS, BAND_ROWS = 32, 4

_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; short ones have their whole sequence."""
    w = words.split(data, offsets, lower=True)
    h, at = words.grams(w, k)
    cut = np.searchsorted(at, w.first)
    out = []
    for i in range(len(offsets) - 1):
        n = int(w.first[i + 1] - w.first[i])
        if n >= k:
            out.append(np.unique(h[cut[i] : cut[i + 1]]))
        elif n:
            own = w.hashes[w.first[i] : w.first[i + 1]]
            odd = words.mix(np.arange(1, n + 1, dtype=_U)) | _U(1)
            out.append(words.mix((own * odd).sum(keepdims=True) + _U(n)))
        else:
            out.append(np.zeros(0, _U))
    return out


def superminhash(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Signatures (documents by ``size``); step in the top byte, fraction below. Empty set: all ones."""
    sig = np.full((len(sets), size), _NONE, _U)
    if not sets:
        return sig
    flat = sig.reshape(-1)
    item = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    perm = None
    for j in range(size):
        draw = words.mix(item + _U(((j + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        k = j + (words.mix(draw) % _U(size - j)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            rows = np.arange(len(item))
            slot = perm[rows, k]
            perm[rows, k] = perm[:, j]
        np.minimum.at(flat, doc * size + slot, (_U(j) << _U(56)) | (draw >> _U(8)))
        open_ = (sig == _NONE).any(axis=1)[doc]
        if not open_.any():
            break
        if perm is None:
            item, doc, k = item[open_], doc[open_], k[open_]
            perm = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(item), 1))
            perm[np.arange(len(item)), k] = 0
        elif not open_.all():
            item, doc, perm = item[open_], doc[open_], perm[open_]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    odd = words.mix(np.arange(1, rows + 1, dtype=_U)) | _U(1)
    cut = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    return words.mix((cut * odd).sum(axis=2) + np.arange(bands, dtype=_U)[None, :])


def _texts(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, offsets = words.buffers(batch.column("text"))
    for i, j in words.chunks(offsets, words.CHUNK // 2):
        yield i, j, shingle_sets(data, offsets[i : j + 1])


def _signer(bands: int, rows: int):
    @memory.tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets in _texts(batch):
                keys = band_keys(superminhash(sets, bands * rows), bands, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[i:j],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, (j - i + 1) * bands, bands, dtype=np.int32), pa.array(keys.reshape(-1))),
                    ],
                    ["doc_id", "n_shingles", "set_id", "bands"],
                )

    return sign


#: Bits of the filter that tells texts to look at again from others, at most: 4 MB. It has
#: room for so many documents; with more wanted ones, texts are joined to them instead.
FILTER_BITS, BITS_EACH = 1 << 25, 16


def _place(bits: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(bits)).cast("int")


def _filter(wanted: DataFrame, n: int) -> np.ndarray:
    """A bit for each hash of ``n`` wanted doc_ids, sixteen places a document. It passes all wanted, and few others."""
    bits = 1 << max(16, (BITS_EACH * n - 1).bit_length())
    words_ = wanted.select(_place(bits).alias("p")).groupBy(F.floor(F.col("p") / 32).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p") % 32)).alias("bits"))
    found = words_.toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[found.column("w").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out


def _sets(passes: np.ndarray | None):
    @memory.tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of the documents that the filter passes, of all without one."""
        for batch in batches:
            if passes is not None:
                p = batch.column("p").to_numpy()
                batch = batch.filter(pa.array((passes[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1))
            for i, j, found in _texts(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array([s.tobytes() for s in found], pa.binary())], ["id", "items"])

    return sets


def _sets_of(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, items) of the wanted documents and maybe of a few others.

    Texts are not shuffled for a few: a filter of bounded size is shipped to them.
    """
    n, known = wanted.count(), base.where("doc_id is not null")
    if BITS_EACH * n > FILTER_BITS:
        return known.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(None), "id long, items binary")
    passes = _filter(wanted, n)
    return known.withColumn("p", _place(32 * len(passes))).mapInArrow(_sets(passes), "id long, items binary")


#: Followers of a leader that are compared in one task, and shingle columns in one product.
FOLLOWERS, COLUMNS = 500, 4096


def _pairs_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(leader's set, document's set, which items of the document the leader has)."""
    lead, own = batch.column("items_lead"), batch.column("items")
    for i in range(len(batch)):
        x, y = (np.frombuffer(c[i].as_buffer(), _U) for c in (lead, own))
        at = np.searchsorted(x, y)
        at[at == len(x)] = 0
        yield x, y, x[at] == y


@memory.tidy
def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lead, id, n_lead, n, both): sizes of two sorted sets and of their intersection."""
    for batch in batches:
        found = np.array([(len(x), len(y), int(same.sum())) for x, y, same in _pairs_of(batch)], np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column("lead"), batch.column("id"), *(pa.array(c) for c in found.T.copy())], ["lead", "id", "n_lead", "n", "both"])


@memory.tidy
def _deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each follower as a bit for each item of the leader and the items that it adds."""
    for batch in batches:
        bits, added, n = [], [], []
        for x, y, same in _pairs_of(batch):
            n.append(len(y))
            bits.append(np.packbits(np.isin(x, y, assume_unique=True)).tobytes())
            added.append(y[~same].tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEYS), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(added, pa.binary())], [*_KEYS, "n", "bits", "added"])


_KEYS = ("lead", "id", "component", "own", "part", "parts_own", "parts_other")


def _comparer(percent: int):
    @memory.tidy_group
    def compare(table: pa.Table) -> pa.Table:
        """Links between followers of one leader that lie in different components, as a forest."""
        ids, comp, n, side = (table.column(c).to_numpy() for c in ("id", "component", "n", "side"))
        bits = np.stack([np.frombuffer(b.as_buffer(), np.uint8) for b in table.column("bits")])
        both = np.zeros((len(ids), len(ids)), np.float32)
        for a in range(0, bits.shape[1], COLUMNS // 8):
            m = np.unpackbits(bits[:, a : a + COLUMNS // 8], axis=1).astype(np.float32)
            both += m @ m.T
        added = [np.frombuffer(b.as_buffer(), _U) for b in table.column("added")]
        row = np.repeat(np.arange(len(ids)), [len(a) for a in added])
        value, kind, times = np.unique(np.concatenate(added), return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1  # items that only one follower adds are in no intersection
        use = times[kind] > 1
        row, kind = row[use], shared[kind[use]]
        order = np.argsort(kind, kind="stable")
        row, kind = row[order], kind[order]
        for a in range(0, int((times > 1).sum()), COLUMNS):
            lo, hi = np.searchsorted(kind, [a, a + COLUMNS])
            m = np.zeros((len(ids), COLUMNS), np.float32)
            m[row[lo:hi], kind[lo:hi] - a] = 1
            both += m @ m.T
        # Sums of ones are exact in single precision below 2**24; the rule itself is in double precision.
        link = ((100.0 + percent) * both.astype(np.float64) >= percent * (n[:, None] + n[None, :])) & (comp[:, None] != comp[None, :])
        if side.min() != side.max():
            link &= side[:, None] != side[None, :]
        x, y = np.nonzero(np.triu(link, 1))
        parent = {}

        def find(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        out = ([], [])
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out[0].append(int(ids[i]))
                out[1].append(int(ids[j]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return compare


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return pairs.join(sets, "id").join(sets.select(F.col("id").alias("lead"), F.col("items").alias("items_lead")), "lead")


def _followers(pairs: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between followers of the same leader, whose components differ after the leaders' links.

    Followers in the leader's own component, which may be very many, meet only the others.
    """
    label = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"component_{c}"))
    both = pairs.join(label("id"), "id", "left").join(label("lead"), "lead", "left")
    # Written, so that each join is dealt by itself and a leader with very many followers can be split.
    named = scratch.save(both.select("lead", "id", F.coalesce("component_id", "id").alias("component"), (F.coalesce("component_id", "id") == F.coalesce("component_lead", "lead")).alias("own")), "named")
    mixed = named.groupBy("lead").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count_if("own").alias("a"), F.count_if(~F.col("own")).alias("b")).where("x <> y")
    mixed = scratch.save(mixed.select("lead", *(F.ceil(F.col(c) / FOLLOWERS).cast("int").alias(p) for c, p in (("a", "parts_own"), ("b", "parts_other")))), "mixed")
    part = F.pmod(F.xxhash64("id"), F.when(F.col("own"), F.col("parts_own")).otherwise(F.col("parts_other"))).cast("int")
    rows = named.join(mixed, "lead").withColumn("part", part)
    delta = _with_sets(rows.select(*_KEYS), sets).select(*_KEYS, "items", "items_lead").mapInArrow(_deltas, "lead long, id long, component long, own boolean, part int, parts_own int, parts_other int, n long, bits binary, added binary")
    # Parts of a leader's followers meet in a task for each two; for most leaders there is one part of either kind.
    upto = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)).otherwise(F.array())
    cross = lambda i, j, side: F.struct(F.lit(True).alias("cross"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    own = upto("parts_other", lambda j: cross(F.col("part"), j, 0))
    other = F.concat(
        upto("parts_own", lambda i: cross(i, F.col("part"), 1)),
        upto("parts_other", lambda j: F.struct(F.lit(False).alias("cross"), F.least("part", j).alias("i"), F.greatest("part", j).alias("j"), F.col("part").alias("side"))),
    )
    meet = delta.withColumn("_m", F.explode(F.when(F.col("own"), own).otherwise(other))).select("lead", "id", "component", "n", "bits", "added", "_m.*")
    return meet.groupBy("lead", "cross", "i", "j").applyInArrow(_comparer(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, n_links.

    ``n_links`` counts the verified links that join the document's class to others in the
    component's spanning links (a lower bound of its links). A null or blank text has an
    empty set and is alone in its component. A null doc_id is linked with nothing: its
    component is null and it is kept. Rows that share a doc_id are one document of the
    link graph: each of its texts counts. An empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.save(base.mapInArrow(_signer(bands, band_rows), "doc_id long, n_shingles long, set_id binary, bands array<long>"), "signed")
    usable = signed.where("set_id is not null and doc_id is not null")
    reps = scratch.save(
        usable.groupBy("set_id").agg(F.min_by(F.struct("n_shingles", "bands"), "doc_id").alias("r"), F.min("doc_id").alias("id")).select("set_id", "id", F.col("r.n_shingles").alias("n"), F.col("r.bands").alias("bands")),
        "classes",
    )
    # A key stands for one band, as the band's number is mixed into it. Counts and leaders are small
    # written tables, so that a key of very many rows is summed before it is dealt and can be split where it is joined.
    spread = reps.select("id", F.explode("bands").alias("key"))
    crowded = scratch.save(spread.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "crowded")
    member = scratch.save(spread.join(crowded, "key"), "buckets")
    # Who meets most others leads: in a family of edits that is the text they were made from.
    met = member.groupBy("id").agg(F.sum("c").alias("met"))
    leads = scratch.save(member.join(met, "id").groupBy("key").agg(F.max_by("id", F.struct("met", F.xxhash64("id"))).alias("lead")), "leads")
    pairs = scratch.save(member.join(leads, "key").where("id <> lead").select("lead", "id").distinct(), "pairs")
    sets = scratch.save(_sets_of(base, pairs.select(F.explode(F.array("lead", "id")).alias("doc_id")).distinct()), "sets")
    if not usable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        sets = scratch.save(sets.withColumn("_x", F.xxhash64("items")).dropDuplicates(["id", "_x"]).drop("_x"), "sets")
    # Lengths alone rule out many pairs before their sets are joined.
    n_of = lambda s: reps.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"))
    near = pairs.join(n_of("id"), "id").join(n_of("lead"), "lead").where(100 * F.least("n_id", "n_lead") >= percent * F.greatest("n_id", "n_lead"))
    fit = scratch.save(near.select("lead", "id"), "fit").distinct()  # an id with several texts has several lengths
    found = _with_sets(fit, sets).select("lead", "id", "items", "items_lead").mapInArrow(_overlaps, "lead long, id long, n_lead long, n long, both long")
    linked = found.where(100 * F.col("both") >= percent * (F.col("n_lead") + F.col("n") - F.col("both")))
    links = scratch.save(linked.select(F.col("lead").alias("a"), F.col("id").alias("b")), "verified")
    labels = components(links)
    more = scratch.save(_followers(pairs, labels, sets, percent), "verified")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    scratch.drop(crowded, member, leads, pairs, sets)
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    classes = reps.select("set_id", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").join(ends, "id", "left").select("set_id", F.coalesce("component", "id").alias("component"), "n_links")
    # Empty sets join nothing; a key of their own spreads them over all tasks.
    own_key = F.coalesce("set_id", F.concat(F.lit("none "), F.xxhash64("doc_id").cast("string")).cast("binary"))
    return (
        signed.select("doc_id", "n_shingles", own_key.alias("set_id"))
        .join(classes, "set_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
            (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("component", "doc_id"))).alias("kept"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
    )

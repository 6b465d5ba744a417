"""Embedders: functions of a text column that give unit vectors, all of one length.

A model is a parameter of what uses it: anything with ``dims`` and ``embed(Column)``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.words import split

WORD = r"[\p{L}\p{N}]+"
_WORD = regex.compile(WORD)


class Embedder(Protocol):
    dims: int

    def embed(self, text: Column) -> Column: ...


@lru_cache(maxsize=1 << 16)
def _place(word: str) -> int:
    """The 32-bit FNV-1a hash of a word's UTF-8 bytes."""
    h = 2166136261
    for b in word.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


@dataclass(frozen=True)
class BagOfWords:
    """Deterministic vectors for tests: folded words of three letters or more, counted in hashed places, normalised. No words: zeros."""

    dims: int = 64
    least: int = 3

    def embed(self, text: Column) -> Column:
        dims, least = self.dims, self.least

        def bag(texts: pa.Array) -> pa.Array:
            owner, word, words = split(texts)
            # A word's places are worked out once for a batch; marks that stay part it.
            places = [[_place(w) % dims for w in _WORD.findall(x) if len(w) >= least] for x in words.to_pylist()]
            times = np.array([len(p) for p in places], np.int64)
            begins = np.append(0, np.cumsum(times))
            every = np.array([x for p in places for x in p], np.int64)
            n = times[word]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = every[np.repeat(begins[word], n) + inside]
            out = np.bincount(np.repeat(owner, n) * dims + place, minlength=len(texts) * dims).astype(float).reshape(len(texts), dims)
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dims, pa.int32()), pa.array((out / np.where(norm > 0, norm, 1)).reshape(-1)))

        return F.arrow_udf(bag, "array<double>")(text)

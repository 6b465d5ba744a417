"""Words of Arrow texts, found by arrays over a batch's bytes: each distinct word is folded once.

A word is a run of letters, numbers and marks of the text as it stands. Folding neither joins
nor parts words, so these are ``text.words`` of ``text.fold``. Letters younger than the JVM's
Unicode, which these do not know, are letters here, as they are in SQL.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def fold(text: str) -> str:
    """As ``text.fold``, of one text."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").replace("Σ", "σ").lower()


@lru_cache(maxsize=1)
def _word_points() -> np.ndarray:
    """Whether each code point is a letter, number or mark."""
    return np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(sys.maxunicode + 1)])


def _in_words(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 texts belong to words."""
    points = _word_points()
    inside = np.append(points[:128], np.zeros(128, bool))[data]
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at].astype(np.int64)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    point = lead & (0x7F >> size)
    for k in (1, 2, 3):
        more = size > k
        point[more] = point[more] << 6 | data[at[more] + k] & 0x3F
    for k in range(4):
        inside[at[points[point] & (size > k)] + k] = True
    return inside


#: Symbols, all of music, that folding takes apart into signs and marks that stay.
_NOTES = "[\U0001d15e-\U0001d164\U0001d1bb-\U0001d1c0]"


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, word, words): for each word of texts, in order, the place of its text and that of the folded word among the distinct ones; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if pc.any(noted := pc.match_substring_regex(texts, _NOTES)).as_py():
        texts = pa.array([unicodedata.normalize("NFD", t) if n else t for t, n in zip(texts.to_pylist(), noted.to_pylist(), strict=True)], pa.string())
    _, offsets, held = texts.buffers()
    edges = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(held, np.uint8)[edges[0] : edges[-1]] if held is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    inside, cut = _in_words(data), np.zeros(len(data) + 1, bool)
    cut[edges] = True
    first = np.flatnonzero(inside & (cut[:-1] | ~np.append(False, inside[:-1])))
    past = np.flatnonzero(inside & (cut[1:] | ~np.append(inside[1:], False))) + 1
    ends = np.append(0, np.cumsum(past - first)).astype(np.int32)
    raw = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(data[inside])).dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(first, edges)))
    folded = pa.array([fold(w) for w in raw.dictionary.to_pylist()], pa.string()).dictionary_encode()
    place = folded.indices.to_numpy(zero_copy_only=False)[raw.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
    # Marks without a letter are no word.
    some = pc.not_equal(folded.dictionary, "").to_numpy(zero_copy_only=False)[place] if len(place) else np.zeros(0, bool)
    return owner[some], place[some], folded.dictionary

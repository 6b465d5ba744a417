"""Byte-level BPE ids of whole text columns.

The pattern that splits text before the merges always breaks before a space that precedes
a visible character, so a text is a run of independent segments. Segments of a chunk of
documents are hashed in numpy, each distinct one is encoded once, and ids are gathered
back; a segment whose bytes differ from the one that stands for its hash is encoded alone.
The vocabulary is read from a tokenizers file; ids equal that library's.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken

from quern.llm import words

#: Bytes of text that are encoded together.
CHUNK = 1 << 20

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space starts a segment before these bytes: visible ASCII and the first bytes of longer
#: characters, but for those (C2, E1, E2, E3) that begin Unicode's own white space.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:] = True
_VISIBLE[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in such vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes documents with the vocabulary file at ``path``."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token.encode() not in self.special}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(spec["model"]["vocab"].values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)

    def _plain(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), np.uint32)

    def one(self, text: bytes) -> np.ndarray:
        """Ids of one text, in which the special tokens' strings are special tokens."""
        for mark, i in self.special.items():
            if mark in text:
                parts = [self.one(p) for p in text.split(mark)]
                return np.concatenate([x for p in parts for x in (p, np.array([i], np.uint32))][:-1])
        return self._plain(text.decode())

    def many(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, offsets of each document's) of texts that lie one after another."""
        b = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        n_docs = len(offsets) - 1
        raw = b.tobytes()
        if any(mark in raw for mark in self.special):
            each = [self.one(raw[x:y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.concatenate(each), np.r_[0, np.cumsum([len(x) for x in each])]
        cut = np.zeros(len(b) + 1, bool)
        if len(b):
            cut[: len(b) - 1] = (b[:-1] == 32) & _VISIBLE[b[1:]]
        cut[offsets] = True
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n_docs + 1, np.int64)
        h = words.hash_ranges(b, starts, ends)
        # A document's first segment may begin with anything, so it is not joined to another.
        first = np.zeros(len(b) + 1, bool)
        first[offsets] = True
        own = first[starts] & ~((b[starts] == 32) & _VISIBLE[b[np.minimum(starts + 1, len(b) - 1)]] & (ends - starts > 1))
        _, pick, kind = np.unique(h, return_index=True, return_inverse=True)
        wrong = np.flatnonzero(~words.same_ranges(b, starts, ends, starts[pick][kind], ends[pick][kind]))
        alone = np.r_[own[pick], np.ones(len(wrong), bool)]
        kind[wrong] = len(pick) + np.arange(len(wrong))
        pick = np.r_[pick, wrong]
        joined = pick[~alone]
        ids = self._plain(b"".join(raw[x:y] for x, y in zip(starts[joined].tolist(), ends[joined].tolist(), strict=True)).decode())
        stop = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum((ends - starts)[joined]), "right")
        n = np.zeros(len(pick), np.int64)
        n[~alone] = np.diff(stop, prepend=0)
        extra = [self._plain(raw[x:y].decode()) for x, y in zip(starts[pick[alone]].tolist(), ends[pick[alone]].tolist(), strict=True)]
        n[alone] = [len(x) for x in extra]
        base = np.zeros(len(pick), np.int64)
        base[~alone] = np.cumsum(n[~alone]) - n[~alone]
        base[alone] = len(ids) + np.cumsum(n[alone]) - n[alone]
        pool = np.concatenate([ids, *extra])
        size = n[kind]
        end = np.cumsum(size)
        out = pool[np.repeat(base[kind] - (end - size), size) + np.arange(end[-1])]
        return out, np.r_[0, end][np.searchsorted(starts, offsets)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a worker; built once."""
    return Encoder(path)

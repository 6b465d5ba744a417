"""Token counters: how many tokens a model would make of a text. A counter is a parameter of what packs text.

A count need not add up: of two neighbouring texts together it may differ from the sum.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol


class Counter(Protocol):
    """``longest``: the most code points that one token stands for."""

    @property
    def longest(self) -> int: ...

    def count(self, text: str) -> int: ...


@dataclass(frozen=True)
class Characters:
    """A token for every ``per`` code points that are begun."""

    per: int = 4

    @property
    def longest(self) -> int:
        return self.per

    def count(self, text: str) -> int:
        return -(-len(text) // self.per)


@lru_cache(maxsize=8)
def _finder(pieces: tuple[str, ...]) -> Callable[[str], list[str]]:
    longest_first = sorted(set(pieces) - {""}, key=lambda p: (-len(p), p))
    return re.compile("|".join([*map(re.escape, longest_first), "(?s:.)"])).findall


@dataclass(frozen=True)
class Pieces:
    """Greedy longest match from the left over a vocabulary; what no piece covers, white space too, is a token a code point."""

    pieces: tuple[str, ...]

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    def count(self, text: str) -> int:
        return len(_finder(self.pieces)(text))

"""Search options and the plan made from them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from vectorloom.errors import InvalidArgument

MAX_K = 1000


@dataclass(frozen=True)
class SearchOptions:
    k: int = 10
    oversearch: float = 0.0
    exact: bool = False
    rerank: bool = False
    ef_search: int = 0

    def __post_init__(self):
        if not 1 <= self.k <= MAX_K:
            raise InvalidArgument("k from 1 to 1000")
        if self.oversearch and (math.isnan(self.oversearch) or self.oversearch < 1):
            raise InvalidArgument("oversearch is 0 or 1 and more")
        if self.ef_search < 0 or 0 < self.ef_search < self.k:
            raise InvalidArgument("ef_search is 0 or k and more")

    @property
    def effective_k(self) -> int:
        """Candidates to keep: k times the factor, halves up, at most MAX_K; k itself if exact."""
        if self.exact:
            return self.k
        return min(MAX_K, max(self.k, math.floor(self.k * (self.oversearch or 1.0) + 0.5)))


@dataclass(frozen=True)
class SearchPlan:
    segments: int
    candidates: int
    effective_k: int
    reranked: bool
    exact: bool
    ef_search: int

"""Parameters of the retrieval pipeline."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Retrieval:
    """Pool sizes and constants, from the first ranked list to the packed context."""

    channel_k: int = 30
    rrf_k: int = 10
    pool: int = 30
    floor: float = 0.12
    per_source: int = 3
    selected: int = 10
    parents: int = 8
    context_chars: int = 6000
    context_tokens: int = 2000
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25


DEFAULT = Retrieval()

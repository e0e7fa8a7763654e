"""Spans found in texts and the columns that contracts ask of them."""

from __future__ import annotations

import hashlib

Span = tuple[int, int, str]  # start, end (code points, end exclusive), kind


def ordered(spans: list[Span], kinds: list[str]) -> list[Span]:
    """By start, then kind as listed."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(set(spans), key=lambda s: (s[0], rank[s[2]], s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()

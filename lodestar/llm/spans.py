"""Spans of text: digests and masking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

Span = tuple[str, int, int]  # kind, start, end: code points, end exclusive


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(spans: Iterable[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def masked(text: str, spans: Iterable[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the earlier one, then the longer."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])

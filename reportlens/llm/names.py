"""Names for added columns."""

from __future__ import annotations

from collections.abc import Iterable


def free(name: str, taken: Iterable[str]) -> str:
    """`name`, with underscores until no column has it; Spark does not tell names apart by case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name

"""Column names that meet no column of a caller's table."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores at its end as make it differ from all names before it, in any case."""
    used, out = {name.lower() for name in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out

"""Column names that don't meet those of the caller."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each after as many underscores as it takes to differ from the taken ones (cases aside) and from each other."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        name = "_" + name
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out

"""Column-name normalisation (metadata only, runs on the driver over names)."""

from __future__ import annotations

import string

KEPT = frozenset(string.ascii_letters + string.digits)
BREAKS = frozenset("_-/()")


def normalize_column_name(name: str) -> str:
    """Snake-case one header name.

    The name is read as runs of ASCII letters and digits. Blanks, ``_``, ``-``,
    ``/`` and parentheses end a run; any other sign is passed over without
    ending it. The runs, in lower case, are joined by ``_``.
    """
    spaced = (ch if ch in KEPT else " " if ch in BREAKS or ch.isspace() else "" for ch in name)
    return "_".join("".join(spaced).lower().split())


def normalize_names(names: list[str], *, reject_collisions: bool = True) -> list[str]:
    """Normalise a header; two raw names landing on one result is an error."""
    out = [normalize_column_name(n) for n in names]
    if reject_collisions:
        first: dict[str, int] = {}
        for i, new in enumerate(out):
            if first.setdefault(new, i) != i:
                raise ValueError(f"columns {names[first[new]]!r} and {names[i]!r} both normalise to {new!r}")
    return out

"""Name groups: names that mean the same person. They are data that a deployment passes; none are built in."""

from __future__ import annotations

import json

from quarry.functions.text import normal, words


def load_groups(path: str) -> list[list[str]]:
    """Groups of a JSON file, an array of arrays of names; whatever else it holds counts as no group."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return [[str(n) for n in g] for g in found if isinstance(g, list)] if isinstance(found, list) else []


def alternates(groups: list[list[str]] | None = None) -> dict[str, list[str]]:
    """Each name's alternates, over all groups it is in, in their order. A name counts by its first word."""
    out: dict[str, list[str]] = {}
    for group in groups or ():
        flat = list(dict.fromkeys(w[0] for w in (words(normal(n)) for n in group) if w))
        for name in flat:
            mine = out.setdefault(name, [])
            mine += [o for o in flat if o != name and o not in mine]
    return out

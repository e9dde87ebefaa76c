"""Paths between sources along relationships."""

from __future__ import annotations

from collections.abc import Iterable

from grainline.model import Relationship


def safe_path(links: Iterable[Relationship], start: str, goal: str, safe: bool = True) -> tuple[tuple[Relationship, ...], int]:
    """A shortest path and how many there are (2: more than one; 0: none). safe: steps that may multiply rows don't count.

    Breadth first; ways to a source are counted up to two, so layered diamonds cost no more than their edges.
    """
    links = sorted(links, key=lambda r: r.name)
    ways, best, layer = {start: 1}, {start: ()}, [start]
    while layer and goal not in ways:
        fresh: dict[str, int] = {}
        for here in layer:
            for link in links:
                if here in (link.source, link.target) and link.source != link.target and not (safe and link.expands(here)):
                    there = link.other(here)
                    if there not in ways:
                        fresh[there] = min(2, fresh.get(there, 0) + ways[here])
                        best.setdefault(there, (*best[here], link))
        ways |= fresh
        layer = sorted(fresh)
    return best.get(goal, ()), ways.get(goal, 0)

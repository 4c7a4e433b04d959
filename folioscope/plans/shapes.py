"""What the rows of an answer must look like before they are published (the ``check`` of Store.publish)."""

from __future__ import annotations

from collections.abc import Callable

#: Columns that every row of a group of answers has, not null.
REQUIRED = {
    "indexes": ("item_id", "title"),
    "dashboards": ("chart", "rows"),
    "nodes": ("item_id", "type"),
    "edges": ("a", "b", "n"),
    "galleries": ("entity", "item_id", "total"),
    "contexts": ("item_id", "parents", "abstract"),
    "maps": ("item_id", "x", "y"),
    "neighbours": ("src", "dst", "rank"),
}


def check(name: str, rows: list[dict]) -> None:
    """An error for the first row of <group>/<answer>.json without its group's columns; other groups may hold anything."""
    group = name.split("/")[0]
    for at, row in enumerate(rows):
        if lacking := [c for c in REQUIRED.get(group, ()) if row.get(c) is None]:
            raise ValueError(f"{name}, row {at}: no {', '.join(lacking)}")
    if group == "galleries" and any(r["total"] < 1 for r in rows):
        raise ValueError(f"{name}: an empty gallery has no file")
    if group == "edges" and any(r["a"] == r["b"] for r in rows):
        raise ValueError(f"{name}: an edge from a node to itself")


def both(*checks: Callable[[str, list], None]) -> Callable[[str, list], None]:
    """All of them, in order."""
    return lambda name, rows: [c(name, rows) for c in checks][-1]

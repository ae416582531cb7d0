"""Splitting JSON into parts that are valid JSON and fit a budget."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

FLOOR = 200


def _cost(value: Any) -> int:
    return len(json.dumps(value, indent=2))


def _inside(key: str, value: Any, budget: int) -> Iterator[dict]:
    """Parts of a value, each back under its key."""
    for part in partition(value, max(budget - len(key) - 12, FLOOR)):
        yield {key: part}


def _packed(items: list, budget: int, empty: Any, join) -> Iterator[Any]:
    """Neighbours put together as long as they fit; the first always does."""
    held, n = empty, 0
    for item in items:
        wider = join(held, item)
        if n and _cost(wider) > budget:
            yield held
            held, n = join(empty, item), 1
        else:
            held, n = wider, n + 1
    if n:
        yield held


def partition(value: Any, budget: int) -> list[Any]:
    """Parts of ``value`` that each serialise within ``budget`` where they can be cut at all.

    An object keeps its keys above what is cut inside; an array with any object or array gives one
    part per element, an array of scalars is packed; a large scalar stays whole.
    """
    if _cost(value) <= budget or not isinstance(value, (dict, list)) or not value:
        return [value]
    out: list[Any] = []
    if isinstance(value, dict):
        if len(value) == 1:
            return [p for k, v in value.items() for p in _inside(k, v, budget)]
        run: list[tuple[str, Any]] = []
        merge = lambda held, kv: {**held, kv[0]: kv[1]}
        for k, v in value.items():
            if _cost({k: v}) > budget:
                out += _packed(run, budget, {}, merge)
                run = []
                out += _inside(k, v, budget)
            else:
                run.append((k, v))
        return [*out, *_packed(run, budget, {}, merge)]
    if any(isinstance(x, (dict, list)) for x in value):
        for x in value:
            out += [[p] for p in partition(x, budget)] if _cost([x]) > budget else [[x]]
        return out
    return list(_packed(value, budget, [], lambda held, x: [*held, x]))


def split_json(text: str, budget: int) -> list[str] | None:
    """Serialised parts of a JSON text, or of ``"key": value`` put in braces; None if neither parses."""
    bare = text.strip().rstrip(",")
    for whole in (bare, "{" + bare + "}"):
        try:
            return [json.dumps(p, indent=2) for p in partition(json.loads(whole), budget)]
        except json.JSONDecodeError:
            continue
    return None

"""Recursive character splitter with word-snapped overlap."""

from __future__ import annotations

SEPARATORS = ("\n\n", "\n", " ", "")
SNAP = 50


def overlap_tail(text: str, size: int) -> str:
    """The last ``size`` characters or so: cut after the first blank that lies within the SNAP
    characters before them, else exactly there."""
    if len(text) <= size:
        return text
    window = text[-min(size + SNAP, len(text)) :]
    blank = window.find(" ", 0, SNAP)
    return window[blank + 1 :] if blank >= 0 else text[-size:]


class _Open:
    """The chunk being filled: parts under one separator, with the length kept aside."""

    def __init__(self, sep: str):
        self.sep, self.parts, self.length = sep, [], 0

    def grown(self, piece: str) -> int:
        return self.length + len(self.sep) + len(piece) if self.length else len(piece)

    def put(self, piece: str) -> None:
        n = self.grown(piece)
        if not self.length:
            self.parts.clear()
        self.parts.append(piece)
        self.length = n

    def take(self) -> str:
        text = self.sep.join(self.parts)
        self.parts, self.length = [], 0
        return text


def split_text(text: str, size: int = 3000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that works.

    A chunk starts with the tail of the one before it where both fit; nothing overlaps out of a
    piece that is itself too long and was split by finer separators.
    """
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    level = next((i for i, s in enumerate(separators) if not s or s in text), None)
    sep = separators[level] if level is not None else ""
    finer = tuple(separators[level + 1 :]) if sep else ()
    out: list[str] = []
    chunk = _Open(sep)
    for piece in text.split(sep) if sep else text:
        if chunk.grown(piece) <= size:
            chunk.put(piece)
            continue
        tail = ""
        if chunk.length:
            full = chunk.take()
            out.append(full.strip())
            tail = overlap_tail(full, overlap)
        if len(piece) > size:
            parts = split_text(piece, size, overlap, finer or ("",))
            if parts and tail and len(tail) + len(sep) + len(parts[0]) <= size:
                parts[0] = tail + sep + parts[0]
            out += parts
            chunk.take()
        else:
            if tail and len(tail) + len(sep) + len(piece) <= size:
                chunk.put(tail)
            chunk.put(piece)
    out.append(chunk.take().strip())
    return [c for c in out if c]


def section_of(chunk: str, titles: frozenset[str]) -> str:
    """Leading lines that are titles, joined; blank lines are passed over."""
    found: list[str] = []
    for line in (x.strip() for x in chunk.split("\n")):
        if line in titles and line:
            found.append(line)
        elif line:
            break
    return " > ".join(found)

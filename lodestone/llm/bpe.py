"""Byte-pair encoding and decoding by an index of pair occurrences.

The distinct words of a batch lie in one array of symbols. A map leads from each adjacent pair to
all its positions; active pairs are taken in ascending rank, every listed position is merged, and
the lists of the pairs that appear are extended. Words met before are taken from a bounded memory.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textkit as tk
from .common import ensure_workers, unclashing

MEMORY_WORDS = 600_000
BATCH_CHARS = 1 << 20
END = "</w>"
# Fixed value: the pre-tokenizer's pattern of this vocabulary; white space is Unicode White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte, as byte-level vocabularies spell them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class WordBpe:
    """Encoder for a byte-level vocabulary with word ends (normaliser: NFC, white space to one
    blank, lower case; text outside the pattern is removed)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.token = dict((i, t) for t, i in vocab.items())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.rank: dict[int, int] = {}  # by both ids of a pair in one number
        self.pair: list[tuple[int, int, int]] = []  # by rank: the pair and what it becomes
        born: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ids = vocab[a], vocab[b]
            if any(born.get(x, -1) > rank for x in ids):
                raise ValueError("a merge uses a symbol that a later merge makes; ranks don't ascend")
            self.rank[ids[0] << 32 | ids[1]] = rank
            self.pair.append((*ids, vocab[a + b]))
            born.setdefault(vocab[a + b], rank)
        sym = byte_symbols()
        if any(s not in vocab or s + END not in vocab for s in sym):
            raise ValueError("the vocabulary lacks a byte")
        self.inner = np.array([vocab[s] for s in sym], np.int64)
        self.last = np.array([vocab[s + END] for s in sym], np.int64)
        self.keys = np.array(sorted(self.rank), np.int64)
        self.key_rank = np.array([self.rank[k] for k in self.keys.tolist()], np.int64)
        self.split = regex.compile(PATTERN)
        self.ascii_split = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\x09-\x0d a-z0-9]+")  # the same on ASCII
        self.stops = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}

    def forget(self) -> None:
        self.ids_of, self.text_of = {}, {}

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if text.isascii():
            return self.ascii_split.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        # every character is lowered on its own: a final sigma stays a plain one
        return self.split.findall(text.replace("Σ", "σ").lower())

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words by the pair occurrence index over them, and where each word's begin."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        bounds = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(r) for r in raws], out=bounds[1:])
        flat = np.frombuffer(b"".join(raws), np.uint8)
        n = len(flat)
        coded = self.inner[flat]
        coded[bounds[1:] - 1] = self.last[flat[bounds[1:] - 1]]
        after = np.arange(1, n + 1)
        after[bounds[1:] - 1] = -1
        before = np.arange(-1, n - 1)
        before[bounds[:-1]] = -1
        rank_of, pair = self.rank.get, self.pair
        where = self._occurrences(coded, after)
        sym, nxt, prev = coded.tolist(), after.tolist(), before.tolist()
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b, new = pair[rank]
            places = where.pop(rank)
            if a == b:
                places.sort()  # overlaps are resolved from the left
            for i in places:
                j = nxt[i]
                if j < 0 or sym[i] != a or sym[j] != b:
                    continue
                sym[i], sym[j] = new, -1
                k = nxt[i] = nxt[j]
                if k >= 0:
                    prev[k] = i
                    r = rank_of(new << 32 | sym[k])
                    if r is not None:
                        if r in where:
                            where[r].append(i)
                        else:
                            where[r] = [i]
                            heapq.heappush(active, r)
                h = prev[i]
                if h >= 0:
                    r = rank_of(sym[h] << 32 | new)
                    if r is not None:
                        if r in where:
                            where[r].append(h)
                        else:
                            where[r] = [h]
                            heapq.heappush(active, r)
        left = np.array(sym, np.int64)
        kept = left >= 0
        ends = np.concatenate(([0], np.cumsum(kept)))[bounds]
        return left[kept].astype("<u4"), ends

    def _occurrences(self, sym: np.ndarray, after: np.ndarray) -> dict[int, list[int]]:
        """The index to begin with: by rank, all places where its pair stands."""
        at = np.flatnonzero(after >= 0)
        key = sym[at] << 32 | sym[at + 1]
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[slot] == key
        at, rank = at[known], self.key_rank[slot[known]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(np.diff(rank)) + 1
        lo = [0, *cut.tolist()] if len(rank) else []
        places = at.tolist()
        return {r: places[a:b] for r, a, b in zip(rank[lo].tolist() if lo else [], lo, [*lo[1:], len(places)], strict=True)}

    def _segments(self, text: str) -> list[str | list[str]]:
        """A text cut at special tokens: a string is one of these, a list holds words."""
        if self.stops is None or not any(s in text for s in self.special):
            return [self.words(text)]
        out: list[str | list[str]] = []
        at = 0
        for m in self.stops.finditer(text):
            out += [self.words(text[at : m.start()]), m[0]]
            at = m.end()
        return [*out, self.words(text[at:])]

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, int, str]]:
        """Per text: ids as little-endian 32-bit integers, their number, the decoded text (tokens
        with single blanks between, as a vocabulary without a decoder spells them)."""
        cut = [self._segments(t) for t in texts]
        parts = [s for segs in cut for s in segs if isinstance(s, list)]
        unmet: set[str] = set()
        for s in parts:
            unmet |= set(s).difference(self.ids_of)
        if len(self.ids_of) + len(unmet) > MEMORY_WORDS:  # a batch's own words are always held
            met = set().union(*parts) - unmet
            self.ids_of, self.text_of = ({w: d[w] for w in met} for d in (self.ids_of, self.text_of))
        new = list(unmet)
        if new:
            ids, ends = self.encode_words(new)
            flat, spelled, ends = ids.tobytes(), list(map(self.token.__getitem__, ids.tolist())), ends.tolist()
            for w, a, b in zip(new, ends, ends[1:], strict=False):
                self.ids_of[w] = flat[4 * a : 4 * b]
                self.text_of[w] = " ".join(spelled[a:b])
        ids_of, text_of = self.ids_of.__getitem__, self.text_of.__getitem__
        out = []
        for segs in cut:
            ids: list[bytes] = []
            decoded: list[str] = []
            for s in segs:
                if isinstance(s, list):
                    ids += map(ids_of, s)
                    decoded += map(text_of, s)
                else:
                    ids.append(self.special[s].to_bytes(4, "little"))
                    decoded.append(s)
            flat = b"".join(ids)
            out.append((flat, len(flat) // 4, " ".join(decoded)))
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids if i in self.token)


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Add ``ids`` (little-endian unsigned 32-bit), ``n_tokens`` and ``decoded`` to ``docs``; columns
    of these names give way.

    ``path``: the vocabulary's file, present on every worker. A null text is an empty one, which has
    no ids and decodes to ''. Special tokens spelled in a text become their ids."""
    return _mapped(docs, path, keep, text, "ids binary, n_tokens bigint, decoded string", lambda r: r)


def report(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of tokens and digests of the ids and of the decoded text."""

    def digest(r: tuple[bytes, int, str]) -> tuple:
        return r[1], hashlib.sha256(r[0]).hexdigest(), hashlib.sha256(r[2].encode("utf-8", "surrogatepass")).hexdigest()

    return _mapped(docs, path, ["doc_id"], "text", "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest)


def _mapped(docs: DataFrame, path: str, keep: list[str] | None, text: str, added: str, shape) -> DataFrame:
    ensure_workers(docs.sparkSession)
    new = T._parse_datatype_string(added).fields
    keep = unclashing(keep or docs.columns, *(f.name for f in new))
    schema = T.StructType([*docs.select(*keep).schema.fields, *new])
    kinds = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        bpe.forget()  # what another task remembers may be large
        gc.disable()  # nothing here is cyclic, and long lists of words are slow to trace
        try:
            for b in batches:
                texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
                rows: list[tuple] = []
                lo = size = 0
                for i, t in enumerate(texts):
                    size += len(t)
                    if size > BATCH_CHARS or i == len(texts) - 1:
                        rows += map(shape, bpe.encode_batch(texts[lo : i + 1]))
                        lo, size = i + 1, 0
                cols = {f.name: pa.array([r[k] for r in rows], kinds[f.dataType.simpleString()]) for k, f in enumerate(new)}
                out = {k: b.column(b.schema.get_field_index(k)) for k in keep} | cols
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
        finally:
            bpe.forget()
            gc.enable()

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(tk.lean(run), schema)

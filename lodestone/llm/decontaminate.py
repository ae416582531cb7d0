"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of 13 words (an item of fewer words is one window). They are
searched per window length; the symbols of the search are words, a block is the last three of them.
The shift table, indexed by the block's hash, holds how far a cursor may move without missing an
occurrence; where it is 0 the suffix bucket names the windows that end in this block, and each is
compared directly, word bytes against word bytes. Cursors of many lanes move together so that the
table look-ups are array operations. The tables are built on the driver, once for a block of the
benchmark, and broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import discard, ensure_workers, materialise, packed, unclashing, unpacked

WINDOW = 13
BLOCK = 3
#: Benchmark text in one index, or one item; and how many indexes one pass over the documents uses.
BLOCK_BYTES = 4 << 20
PASS_BLOCKS = 2
LANES = 2048


class WuManber:
    """Shift and suffix tables for windows of one length; ``start``: the first word of each in
    ``words``, the benchmark's own."""

    def __init__(self, words: tk.Words, start: np.ndarray, length: int):
        self.length = length
        self.block = min(BLOCK, length)
        h = words.hash
        self.whole = tk.rolled(h, length)[start]
        self.bits = int(np.clip(np.ceil(np.log2(len(start) * length + 1)) + 1, 14, 22))
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.int16)
        for q in range(self.block, length + 1):
            np.minimum.at(self.shift, self._slot([h[start + i] for i in range(q - self.block, q)]), length - q)
        suffix = self._slot([h[start + i] for i in range(length - self.block, length)])
        self.member = np.argsort(suffix, kind="stable").astype(np.int32)
        self.bucket_of = suffix[self.member].astype(np.int32)
        # the windows' bytes: spans of one text of single-spaced words
        self.at = words.spaced_at(start).astype(np.int32), (words.spaced_at(start + length) - 1).astype(np.int32)

    def _slot(self, cols) -> np.ndarray:
        acc = np.zeros(len(cols[0]), np.uint64)
        for c in cols:
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + c
        return (tk.mix(acc) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, words: tk.Words, spaced: bytes) -> list[tuple[int, int]]:
        """(index of the last word, window) of every occurrence; a text's edge is never crossed.
        ``spaced``: the benchmark's words, single-spaced."""
        n = len(words.hash)
        if n < self.length:
            return []
        text_of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        per = -(-n // LANES)
        cur = np.arange(self.length - 1, n, max(per, 1))
        stop = np.minimum(cur + max(per, 1), n)
        found: list[tuple[int, int]] = []
        h = words.hash
        while len(cur):
            step = self.shift[self._slot([h[cur - k] for k in range(self.block - 1, -1, -1)])].astype(np.int64)
            hit = cur[step == 0]
            if len(hit):
                found += self._compare(words, spaced, hit[text_of[hit] == text_of[hit - self.length + 1]])
            cur = cur + np.maximum(step, 1)
            live = cur < stop
            cur, stop = cur[live], stop[live]
        return found

    def _compare(self, words: tk.Words, spaced: bytes, ends: np.ndarray) -> list[tuple[int, int]]:
        if not len(ends):
            return []
        h, k = words.hash, self.length
        slot = self._slot([h[ends - i] for i in range(self.block - 1, -1, -1)])
        lo, hi = np.searchsorted(self.bucket_of, slot), np.searchsorted(self.bucket_of, slot, "right")
        reps = hi - lo
        at = np.repeat(ends, reps)
        cand = self.member[np.repeat(lo - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(reps.sum())]
        acc = np.zeros(len(at), np.uint64)
        for i in range(k - 1, -1, -1):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[at - i]
        keep = tk.mix(acc) == self.whole[cand]  # a cheap refusal before the bytes are compared
        lo, hi = self.at[0][cand[keep]].tolist(), self.at[1][cand[keep]].tolist()
        return [(e, w) for e, w, a, b in zip(at[keep].tolist(), cand[keep].tolist(), lo, hi, strict=True) if words.joined(e - k + 1, e + 1) == spaced[a:b]]


class BenchmarkIndex:
    """All windows of one block of benchmark items, as arrays: equal windows are one, with the items
    that hold it."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        words = tk.Words([t for _, t in items])
        n = np.diff(words.first)
        count = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), count)
        start = words.first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(n, window)[item]
        self.spaced = words.spaced()
        self.names = [i for i, _ in items]
        self.searches: list[WuManber] = []
        self.holders: list[tuple[np.ndarray, np.ndarray]] = []  # by window: from where, and of whom
        for k in np.unique(length).tolist():
            s, own = start[length == k], item[length == k]
            first, of = np.unique(self._same(words, s, k), return_inverse=True)
            pairs = np.unique(np.stack([of, own]), axis=1)
            self.searches.append(WuManber(words, s[first], k))
            self.holders.append((np.searchsorted(pairs[0], np.arange(len(first) + 1)), pairs[1]))

    def _same(self, words: tk.Words, start: np.ndarray, k: int) -> np.ndarray:
        """For each window one that equals it: windows of equal hash are compared byte by byte."""
        whole = tk.rolled(words.hash, k)[start]
        lo, hi = words.spaced_at(start), words.spaced_at(start + k) - 1
        order = np.argsort(whole, kind="stable")
        same = np.arange(len(start))
        for j in (np.flatnonzero(whole[order][1:] == whole[order][:-1]) + 1).tolist():
            a, b = int(same[order[j - 1]]), int(order[j])
            if self.spaced[lo[a] : hi[a]] == self.spaced[lo[b] : hi[b]]:
                same[b] = a
        return same

    def search(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray], list[set[str]]]:
        """Per text: number of words, hit spans as (from, to) word pairs, items found."""
        words = tk.Words(texts)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        return self.search_words(words, spans, items)

    def search_words(self, words: tk.Words, spans: list[list[tuple[int, int]]], items: list[set[str]]) -> tuple[np.ndarray, list[np.ndarray], list[set[str]]]:
        """Adds to the spans and items of each text."""
        for search, (of, owner) in zip(self.searches, self.holders, strict=True):
            found = search.find(words, self.spaced)
            if found:
                doc = np.searchsorted(words.first, [e for e, _ in found], "right") - 1
                for d, (e, w) in zip(doc.tolist(), found, strict=True):
                    base = int(words.first[d])
                    spans[d].append((e - search.length + 1 - base, e + 1 - base))
                    items[d].update(x for i in owner[of[w] : of[w + 1]].tolist() if (x := self.names[i]) is not None)
        return np.diff(words.first), spans, items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


FOUND = "n_words bigint, hit_spans array<bigint>, hit_items array<string>"


def _pass(indexes, text: str, carry: list[str]):
    """``indexes``: broadcast, so that they are built once and a worker holds one copy for all its tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.column_bytes(batch, text)
            had = batch.schema.get_field_index("hit_spans") >= 0
            old_spans = batch.column(batch.schema.get_field_index("hit_spans")).to_pylist() if had else [None] * len(texts)
            old_items = batch.column(batch.schema.get_field_index("hit_items")).to_pylist() if had else [None] * len(texts)
            n_words: list[int] = []
            out_spans: list[list[int]] = []
            out_items: list[list[str]] = []
            for lo, hi in tk.slices([len(t or b"") for t in texts]):
                words = tk.Words(texts[lo:hi])  # once for all indexes
                spans: list[list[tuple[int, int]]] = [list(zip(f[::2], f[1::2], strict=True)) if (f := old_spans[i]) else [] for i in range(lo, hi)]
                names = [set(old_items[i] or ()) for i in range(lo, hi)]
                for index in indexes.value:
                    index.search_words(words, spans, names)
                n_words += np.diff(words.first).tolist()
                out_spans += [[x for s in merge_spans(own) for x in s] for own in spans]
                out_items += map(sorted, names)
            yield tk.replace_columns(batch, carry, n_words=pa.array(n_words, pa.int64()), hit_spans=pa.array(out_spans, pa.list_(pa.int64())), hit_items=pa.array(out_items, pa.list_(pa.string())))

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``n_words, hit_spans, hit_items`` to ``docs`` (``keep``: columns to carry; all by default);
    a column of these names is replaced.

    ``hit_spans`` is a flat list from0, to0, from1, ... of word positions inside any occurrence.
    The benchmark is a stated query set: its items are dealt by hash into blocks of about
    ``block_bytes`` of text (or one item). ``PASS_BLOCKS`` blocks at a time come to the driver, whose
    indexes are broadcast, and one pass searches the documents for all of them, tokenising each
    text once; between passes what was found is written, so neither the driver nor a task ever
    holds more than one pass's blocks. The documents are never shuffled. A text is held whole, at
    some ten bytes of memory for each of its own.

    Null texts and texts without words have no hits; null or wordless items have no windows; an item
    with a null id marks words but is not listed; repeated items count once; an empty benchmark
    leaves every document clean.
    """
    spark = docs.sparkSession
    ensure_workers(spark)
    keep = unclashing(keep or docs.columns, "n_words", "hit_spans", "hit_items")
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t")).where("t is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("t"), F.lit(blocks)))
    out = docs.select(*dict.fromkeys([*keep, text]))
    carry = out.columns
    schema = T.StructType([*out.schema.fields, *T._parse_datatype_string(FOUND).fields])
    last = None
    for at in range(0, blocks, PASS_BLOCKS):
        dealt: dict[int, list[tuple[str | None, bytes]]] = {}
        for r in rows.where(F.col("block").between(at, at + PASS_BLOCKS - 1)).orderBy(F.col("i").asc_nulls_first(), "t").collect():
            dealt.setdefault(r.block, []).append((r.i, bytes(r.t)))
        if not dealt and (at or blocks > PASS_BLOCKS):
            continue
        indexes = spark.sparkContext.broadcast([BenchmarkIndex(items, window) for items in dealt.values()])
        out = out.mapInArrow(tk.lean(_pass(indexes, text, carry)), schema)
        if at + PASS_BLOCKS < blocks:
            out, spent = materialise(out, "leaks"), last
            last = out
            if spent is not None:
                discard(spent)
    return out.select(*keep, "n_words", "hit_spans", "hit_items")


def n_hit():
    """Hit words of a row of :func:`find_contamination`: sum of the lengths of its spans."""
    return F.expr("aggregate(sequence(0, greatest(size(hit_spans) - 2, 0), 2), 0L, (s, i) -> s + coalesce(try_element_at(hit_spans, i + 2) - try_element_at(hit_spans, i + 1), 0L))")


def contaminated(numerator: int = 1, denominator: int = 20):
    """True where at least ``numerator/denominator`` of the words, and one, is hit."""
    return (F.col("n_hit") > 0) & (F.lit(denominator) * F.col("n_hit") >= F.lit(numerator) * F.col("n_words"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: counts, digest of the items found, and the verdict."""
    found = find_contamination(docs, benchmark, keep=["doc_id", "text"]).withColumn("n_hit", n_hit())
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("bigint").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold any window of the benchmark, however long they are.

    The share of hit words, by which :func:`report` calls a document contaminated, plays no part: a
    passage leaks as well from a long document as from a short one. Documents with null texts and,
    if the benchmark has no words, all documents stay."""
    found = find_contamination(packed(docs, "doc_id", "text"), benchmark)
    return unpacked(found.where(F.size("hit_spans") == 0), docs.columns, "doc_id", "text")

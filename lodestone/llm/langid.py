"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of its hashed letter trigrams, word edges included. Each
language has several centroids, found by spherical k-means over its training vectors; the nearest
by cosine gives the language, and a text farther than a centroid's radius allows is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import ensure_workers, packed, unclashing, unpacked
from .quality import held_out

#: Texts of each language that the centroids are fitted on at most, and of all languages together;
#: the one bound on a sample here.
MAX_FIT_TEXTS, MAX_FIT_TOTAL = 600, 6000
BITS = 13
DIMS = 1 << BITS
CENTROIDS = 4
#: Texts of fewer trigrams seed no centroid and set no floor.
LONG = 50
#: Characters that are counted at a time, so that a long text takes no more memory than a short one.
PIECE = 1 << 18
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(counts per text and bin, has a letter). Letters are lower-cased, all else is a word edge."""
    out = np.zeros((len(texts), DIMS), np.float32)
    lettered = np.zeros(len(texts), bool)
    parts = [(i, t, lo) for i, t in enumerate(texts) for lo in range(0, len(t), PIECE)]
    for lo, hi in tk.slices([4 * min(len(t) - at, PIECE) for _, t, at in parts]):
        # each piece with the characters on both its sides, then an edge
        own = [(i, t[max(at - 1, 0) : at + PIECE + 1].lower(), at) for i, t, at in parts[lo:hi]]
        code = np.frombuffer("\n\n".join(["", *(t for _, t, _ in own), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        alpha = _letters()[code]
        sym = np.where(alpha, code, 0).astype(np.uint64)
        h = (sym[:-2] * np.uint64(0x9E3779B97F4A7C15) + sym[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + sym[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
        h = (h >> np.uint64(64 - BITS)).astype(np.int64)
        at = 2
        for i, low, start in own:
            # trigrams centred in the piece itself
            a = at + (start > 0)
            b = at + len(low) - (start + PIECE < len(texts[i]))
            mid = alpha[a:b]
            if mid.any():
                lettered[i] = True
                out[i] += np.bincount(h[a - 1 : b - 1][mid], minlength=DIMS)
            at += len(low) + 2
    return out, lettered


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    idf: np.ndarray
    centre: np.ndarray
    lang: list[str]
    floor: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def predict(self, counts: np.ndarray, lettered: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) per text."""
        if not len(self.lang):
            return [UNKNOWN] * len(counts), np.zeros(len(counts)), np.ones(len(counts), bool)
        cos = self.vectors(counts) @ self.centre.T
        best = cos.argmax(1)
        score = np.clip(cos[np.arange(len(best)), best].astype(np.float64), 0, 1)
        # few trigrams carry a wide spread of cosines, so the floor sinks with their number
        ease = np.minimum(1.0, np.sqrt(counts.sum(1) / 200.0))
        rejected = ~lettered | (score < self.floor[best] * ease)
        return [self.lang[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, score, 0.0), rejected


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread seeds (k-means++ on 1 - cosine), drawn alike in every run."""
    rng = np.random.default_rng(k)
    centre = x[[int(rng.integers(len(x)))]]
    while len(centre) < min(k, len(x)):
        far = np.maximum(1 - (x @ centre.T).max(1).astype(np.float64), 0)
        if far.sum() < 1e-6:
            break
        centre = np.vstack([centre, x[rng.choice(len(x), p=far / far.sum())]])
    for _ in range(rounds):
        own = (x @ centre.T).argmax(1)
        centre = _unit(np.vstack([x[own == j].mean(0) if (own == j).any() else centre[j] for j in range(len(centre))]))
    return centre


def packed_counts(counts: np.ndarray) -> bytes:
    """The bins of a text that are not empty: their numbers, then their counts."""
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + counts[at].astype("<f4").tobytes()


def unpacked_counts(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), DIMS), np.float32)
    for row, x in zip(out, rows, strict=True):
        n = len(x) // 6
        row[np.frombuffer(x, "<u2", n)] = np.frombuffer(x, "<f4", n, 2 * n)
    return out


def fit_centroids(samples: dict[str, list[bytes]], k: int = CENTROIDS) -> Centroids:
    """``samples``: packed counts by language, of which one language's are unpacked at a time.
    Centroids are those of the long texts, where a language has some. The floor of a centroid is half
    the least cosine but 1 % of its own long texts, far below what a clean text of the language has;
    with fewer than 20 of these, that of the language."""
    samples = {g: x for g, x in sorted(samples.items()) if x}
    if not samples:
        return Centroids(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], np.zeros(0))
    texts = sum(map(len, samples.values()))
    idf = (np.log((1 + texts) / (1 + sum((unpacked_counts(x) > 0).sum(0) for x in samples.values()))) + 1).astype(np.float32)
    centre, lang, floor = [], [], []
    for g, rows in samples.items():
        x = unpacked_counts(rows)
        long = x.sum(1) >= LONG
        v = _unit(np.log1p(x[long] if long.any() else x) * idf)
        c = cluster(v, k)
        cos = v @ c.T
        own = cos.argmax(1)
        least = lambda best: 0.5 * float(np.quantile(best, 0.01)) if long.any() else 0.0  # noqa: B023, E731
        for j in range(len(c)):
            mine = cos[own == j, j]
            floor.append(least(mine if len(mine) >= 20 else cos.max(1)))
            lang.append(g)
        centre.append(c)
    return Centroids(idf, np.concatenate(centre).astype(np.float32), lang, np.array(floor))


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def fit(docs: DataFrame, usable=None, max_texts: int = MAX_FIT_TEXTS, k: int = CENTROIDS) -> Centroids:
    """Learn from text and non-null lang of the rows that ``usable`` (a condition on doc_id) admits.

    Per language, at most ``max_texts`` lettered texts are drawn, those of least hash of id and text
    (``MAX_FIT_TOTAL`` over all languages); which ones doesn't depend on how the table is dealt out.
    A task keeps no more than these of its own, so no more of a language leave it.
    """
    ensure_workers(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known if usable is None else known.where(usable)
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit_centroids({})
    most = max(1, min(max_texts, MAX_FIT_TOTAL // len(sizes)))
    share = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, int(min(1.0, 1.5 * most / n) * (1 << 30)))])
    h = F.xxhash64(F.lit(5), "doc_id", "text")
    drawn = known.select("lang", "text", h.alias("h")).where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[int, bytes]]] = {}
        for b in batches:
            langs, hs, texts = b.column(b.schema.get_field_index("lang")).to_pylist(), b.column(b.schema.get_field_index("h")).to_pylist(), _texts(b, "text")
            for lo in range(0, len(texts), 128):
                counts, lettered = trigram_counts(texts[lo : lo + 128])
                for i in np.flatnonzero(lettered).tolist():
                    held.setdefault(langs[lo + i], []).append((hs[lo + i], packed_counts(counts[i])))
                held = {g: sorted(x)[:most] if len(x) > most else x for g, x in held.items()}
        rows = [(g, *x) for g, xs in held.items() for x in xs]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["lang", "h", "x"])

    least = Window.partitionBy("lang").orderBy("h", "x")
    rows = drawn.mapInArrow(tk.lean(run), "lang string, h bigint, x binary").withColumn("at", F.row_number().over(least)).where(F.col("at") <= most)
    found: dict[str, list[bytes]] = {}
    for r in rows.orderBy("lang", "at").collect():
        found.setdefault(r.lang, []).append(bytes(r.x))
    model = fit_centroids(found, k)
    del found
    tk.trim()
    return model


def apply(docs: DataFrame, model: Centroids, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (cosine to the nearest centroid) and ``rejected``; columns of
    these names give way.

    A null text, or one without a letter, is ``und``, scores 0 and is rejected; so is every text if
    nothing was learned. Ties go to the first centroid in order of language."""
    keep = unclashing(keep or docs.columns, "lang_pred", "score", "rejected")
    schema = T.StructType([*docs.select(*keep).schema.fields, *T._parse_datatype_string("lang_pred string, score double, rejected boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b, text)
            langs: list[str] = []
            scores, rejects = [np.zeros(0)], [np.zeros(0, bool)]
            for lo in range(0, len(texts), 128):
                g, s, r = model.predict(*trigram_counts(texts[lo : lo + 128]))
                langs += g
                scores.append(s)
                rejects.append(r)
            yield tk.replace_columns(b, keep, lang_pred=pa.array(langs, pa.string()), score=pa.array(np.concatenate(scores), pa.float64()), rejected=pa.array(np.concatenate(rejects)))

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(tk.lean(run), schema)


def report(docs: DataFrame) -> DataFrame:
    """Predictions for every document by centroids learned outside the held-out quarter."""
    model = fit(docs, ~held_out(4, 2))
    rows = docs.select("doc_id", "text", held_out(4, 2).alias("held_out"))
    return apply(rows, model, keep=["doc_id", "held_out"])


def drop_rejected(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose language is rejected; learned from all rows of ``docs``."""
    model = fit(docs)
    out = apply(packed(docs, "doc_id", "text"), model).where("not rejected")
    return unpacked(out, docs.columns, "doc_id", "text")

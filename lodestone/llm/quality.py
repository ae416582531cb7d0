"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows marked good; the unlabelled set is web text drawn without
regard to its labels. A linear scorer minimises the non-negative unbiased risk of Kiryo et al.
(2017), ``pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1))``, under a class prior ``pi`` estimated from
positives against unlabelled texts by the best bin of Garg et al. (2021). Bad marks are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import ensure_workers, unclashing

#: Rows of each kind that the classifier is fitted on at most; the one bound on a sample here.
MAX_FIT_ROWS = 4096
WORD_BINS = 256
#: Byte classes: lower, upper, digit, space, line end, high byte, then one for each mark below, then other.
MARKS = ".,;:!?'\"()[]{}<>|*#$%&@/\\=+-_~^`"
CLASSES = 6 + len(MARKS) + 1


def _class_table() -> np.ndarray:
    t = np.full(256, CLASSES - 1, np.int64)
    t[97:123], t[65:91], t[48:58], t[32], t[128:] = 0, 1, 2, 3, 5
    t[9] = 3
    t[10] = t[13] = 4
    for i, m in enumerate(MARKS):
        t[ord(m)] = 6 + i
    return t


_CLASS = _class_table()
PAIR = 12
_FOLD = np.minimum(_CLASS, PAIR - 1)  # the frequent classes alone have pair features
SHAPES = 8
DIMS = CLASSES + PAIR * PAIR + SHAPES + WORD_BINS


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row of ``DIMS`` numbers per text, each a share or a bounded logarithm, from the whole text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for lo, hi in tk.slices([len(t or b"") for t in texts]):
        part = [t or b"" for t in texts[lo:hi]]
        w = tk.Words(part)
        bins = (w.hash >> np.uint64(56)).astype(np.int64) % WORD_BINS
        same = np.zeros(len(w.hash), bool)
        same[1:] = w.hash[1:] == w.hash[:-1]
        length = w.end - w.start
        for i, t in enumerate(part):
            a, b = int(w.first[i]), int(w.first[i + 1])
            raw = np.frombuffer(t, np.uint8)
            row, n, k = out[lo + i], max(len(raw), 1), max(b - a, 1)
            row[:CLASSES] = np.bincount(_CLASS[raw], minlength=CLASSES) / n
            f = _FOLD[raw]
            row[CLASSES : CLASSES + PAIR * PAIR] = np.bincount(f[:-1] * PAIR + f[1:], minlength=PAIR * PAIR)[: PAIR * PAIR] / n
            at = CLASSES + PAIR * PAIR
            row[at] = np.log1p(len(raw)) / 16
            row[at + 1] = np.log1p(b - a) / 16
            row[at + 2] = same[a + 1 : b].sum() / k
            row[at + 3] = len(np.unique(w.hash[a:b])) / k
            row[at + 4] = min(length[a:b].mean() if b > a else 0, 40) / 40
            row[at + 5] = min(length[a:b].std() if b > a else 0, 40) / 40
            row[at + 6] = (length[a:b] > 24).sum() / k
            row[at + 7] = 1.0 if b == a else 0.0
            row[at + SHAPES :] = np.sqrt(np.bincount(bins[a:b], minlength=WORD_BINS) / k)
    return out


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def nn_pu_fit(pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = 60, rate: float = 0.01, l2: float = 1e-3, seed: int = 7, batch: int = 256) -> Scorer:
    """Minimise the non-negative PU risk with the logistic loss by Adam over shuffled mini-batches."""
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    clip = lambda x: np.clip((x - mean) / scale, -6, 6).astype(np.float64)
    xp, xu = clip(pos), clip(unl)
    rng = np.random.default_rng(seed)
    theta = np.zeros(xp.shape[1] + 1)
    m, v, t = np.zeros_like(theta), np.zeros_like(theta), 0
    tail, tails = np.zeros_like(theta), 0
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    steps = max(1, -(-max(len(xp), len(xu)) // batch))
    for epoch in range(epochs):
        op, ou = (np.resize(rng.permutation(len(x)), steps * batch) for x in (xp, xu))
        for s in range(steps):
            p, u = xp[op[s * batch : (s + 1) * batch]], xu[ou[s * batch : (s + 1) * batch]]
            zp, zu = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
            grad = lambda x, d: np.append(x.T @ d, d.sum()) / len(d)
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g_neg = grad(u, sig(zu)) - prior * grad(p, sig(zp))
            # a negative estimate is overfitting: its gradient is ascended, as in the paper
            g = prior * grad(p, -sig(-zp)) + g_neg if negative >= 0 else -g_neg
            g[:-1] += l2 * theta[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if epoch >= epochs // 2:
            tail, tails = tail + theta, tails + 1
    theta = tail / max(tails, 1)
    return Scorer(mean, scale, theta[:-1], float(theta[-1]))


def estimated_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled rows.

    A scorer of positives against unlabelled is fitted on one half of each; on the other half, the
    share of unlabelled rows above a threshold over that of positives bounds the prior from above,
    and is least where only positives are. The threshold is that of the least upper confidence
    bound of this ratio. Both halves take both parts, and what is returned lies two standard errors
    below the mean: too small a prior costs little, too large a one passes bad texts for good."""
    if min(len(pos), len(unl)) < 4:
        return 0.5
    found = [_best_bin(pos[i::2], unl[i::2], pos[1 - i :: 2], unl[1 - i :: 2], delta) for i in (0, 1)]
    pi = sum(found) / 2
    return float(np.clip(pi - 2 * np.sqrt(max(pi * (1 - pi), 0) * (1 / len(pos) + 1 / len(unl))), 0.02, 0.98))


def _best_bin(pos: np.ndarray, unl: np.ndarray, other_pos: np.ndarray, other_unl: np.ndarray, delta: float) -> float:
    g = nn_pu_fit(pos, unl, 0.5, epochs=40)
    p, u = np.sort(g.score(other_pos)), np.sort(g.score(other_unl))
    cut = np.unique(np.concatenate([p, u]))
    above = lambda x: (len(x) - np.searchsorted(x, cut)) / len(x)
    qp, qu = above(p), above(u)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    at = int(np.argmin((qu + slack) / np.maximum(qp, 1e-9) + (qp < 0.01) * 1e9))
    return float(min(qu[at] / max(qp[at], 1e-9), 1.0))


def _matrix(df: DataFrame, limit: int, salt: int) -> np.ndarray:
    """Features of at most ``limit`` rows, those of least hash: the same ones, in the same order,
    however the table is dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(tk.column_bytes(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("h")), pa.array([r.tobytes() for r in x], pa.binary())], names=["h", "x"])

    rows = df.select(F.xxhash64(F.lit(salt + 1), "doc_id", "text").alias("h"), "text").mapInArrow(tk.lean(run), "h bigint, x binary").orderBy("h", "x").limit(limit).collect()
    return np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(len(rows), DIMS)


def _drawn(n: int, limit: int, salt: int):
    """Condition on a row, by its hash, that about a fifth more than ``limit`` of ``n`` rows meet."""
    return F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) < int(min(1.0, 1.2 * limit / max(n, 1)) * (1 << 30))


def held_out(mod: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, usable=None, max_rows: int = MAX_FIT_ROWS) -> Scorer | None:
    """Fit on the rows that ``labels(doc_id, quality)`` marks good against all rows, of those that
    ``usable`` (a condition on doc_id) admits; at most ``max_rows`` of either, drawn by a hash.

    Conflicting marks of one id: the worst counts. Null ids, marks and texts are not learned from.
    None if there is no positive."""
    ensure_workers(docs.sparkSession)
    usable = F.lit(True) if usable is None else usable
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).where(usable).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = marks.where("quality = 1").select("doc_id")
    web = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).where(usable).select("doc_id", "text")
    known, total = good.count(), web.select("doc_id").count()
    if not known or not total:
        return None
    drawn = _drawn(known, max_rows, 11)
    pos = _matrix(web.where(drawn).join(good.where(drawn), "doc_id", "left_semi"), max_rows, 11)
    unl = _matrix(web.where(_drawn(total, max_rows, 23)), max_rows, 23)
    if not len(pos) or not len(unl):
        return None
    return nn_pu_fit(pos, unl, estimated_prior(pos, unl))


def apply(docs: DataFrame, model: Scorer | None, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5); columns of these names give way.
    A null text scores as an empty one; without a model every score is 0.5. The score depends on
    the text alone. A text is held whole, at some forty bytes of memory for each of its own."""
    keep = unclashing(keep or docs.columns, "score", "predicted")
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = tk.column_bytes(b, text)
            s = np.full(len(texts), 0.5) if model is None else model.score(features(texts))
            yield tk.replace_columns(b, keep, score=pa.array(s, pa.float64()), predicted=pa.array((s >= 0.5).astype(np.int32)))

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(tk.lean(run), schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every document by a model learned from rows outside the held-out third."""
    model = fit(docs, labels, ~held_out(3, 1))
    rows = docs.select("doc_id", "text", held_out(3, 1).alias("held_out"))
    return apply(rows, model, keep=["doc_id", "held_out"])

"""N-gram Jaccard self-join with Bayesian pruning of candidates.

Documents are sets of five-word shingles; a link joins two different sets whose Jaccard similarity
is 0.8 or more. Rows of one set are a class and are never paired with each other. Classes that share
a MinHash band lie in one bucket; inside it, signatures are compared a few values at a time and a
pair is dropped once the posterior probability that it reaches the threshold is below the tolerance
(Satuluri and Parthasarathy 2012). Only classes with a pair that is left have their texts fetched,
and these pairs are verified on the shingles themselves.

Buckets of equal members are one. A pair in several buckets counts in the first of them; where the
buckets of a connected component would cost more comparisons than the component as a whole, as in a
tight group of near copies, the component is the bucket. A large bucket is cut into blocks of bounded
rows and bytes, two of which meet in a task; a task returns one row per class with links (how many)
and one edge per class towards its tree, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import components, discard, ensure_workers, looked_up, materialise, may_have, packed, sieved, unpacked

WIDTH = 5
THRESHOLD = 0.8
#: Rows and bands: a pair at 0.8 shares no band with probability (1 - 0.8**5)**36 < 7e-7.
ROWS, BANDS = 5, 36
HASHES = ROWS * BANDS
#: A pair is dropped when reaching the threshold is less probable than this.
TOLERANCE = 1e-9
STEP = 20
#: Classes and bytes of text in a block, on average; a longer text is a block's own.
BLOCK, BLOCK_BYTES = 256, 8 << 20

_A = np.random.default_rng(8191).integers(1, 2**62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a shingle set (multiply-shift of mixed hashes), cut to 16 bits: unequal values
    agree once in 65,536 times, which can only keep a pair that verification then refuses."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 512):
        np.minimum(out, (_A[:, None] * s[None, lo : lo + 512]).min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint16)


def band_keys(sig: str = "sig"):
    """The keys of a signature's bands, in order."""
    width = 2 * ROWS  # bytes
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda t: F.xxhash64(t, F.substring(sig, t * width + 1, F.lit(width))))


def class_key(s: np.ndarray) -> bytes | None:
    """128-bit name of a shingle set; None for an empty one."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> dict[int, int]:
    """After n values, the fewest matches with which P(similarity >= threshold | matches) is at
    least ``tolerance``; uniform prior, so the posterior is Beta(matches + 1, n - matches + 1)."""
    x = np.linspace(0, 1, 20001)[1:-1]
    upper = x >= threshold
    out = {}
    for n in range(step, hashes + 1, step):
        for m in range(n + 1):
            like = m * np.log(x) + (n - m) * np.log1p(-x)
            like = np.exp(like - like.max())
            if like[upper].sum() / like.sum() >= tolerance:
                out[n] = m
                break
    return out


_LEAST: dict[int, int] = {}


def surviving_pairs(sig: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``sig`` (within ``left``, or between ``left`` and ``right``) not yet dropped."""
    if not _LEAST:
        _LEAST.update(least_matches())
    other = left if right is None else right
    got = np.zeros((len(left), len(other)), np.uint16)
    for k in range(STEP):
        got += sig[left, k][:, None] == sig[other, k][None, :]
    ok = got >= _LEAST[STEP]
    if right is None:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    got = got[i, j].astype(np.int64)
    i, j = left[i], other[j]
    for n in range(2 * STEP, HASHES + 1, STEP):
        if not len(i):
            break
        for lo in range(0, len(i), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            got[part] += (sig[i[part], n - STEP : n] == sig[j[part], n - STEP : n]).sum(1)
        keep = got >= _LEAST[n]
        i, j, got = i[keep], j[keep], got[keep]
    return i, j


def verify(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Whether each pair's exact similarity reaches the threshold."""
    size = np.array([len(s) for s in sets], np.int64)
    common = np.zeros(len(i), np.int64)
    used = np.unique(np.concatenate([i, j])) if len(i) else np.empty(0, np.int64)
    if len(i) <= 2 * len(used):
        for p, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            common[p] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    else:  # many pairs: intersections are products of 0/1 matrices over shared shingles
        owner = np.repeat(np.arange(len(used)), size[used])
        value, column, times = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
        keep = times[column] > 1
        owner, column = owner[keep], column[keep]
        number = np.cumsum(times > 1) - 1
        column = number[column]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        total = np.zeros((len(used), len(used)), np.float32)
        width = 4096
        for c in range(0, int(number[-1]) + 1 if len(number) else 0, width):
            lo, hi = np.searchsorted(column, [c, c + width])
            m = np.zeros((len(used), width), np.float32)
            m[owner[lo:hi], column[lo:hi] - c] = 1
            total += m @ m.T
        common = total[np.searchsorted(used, i), np.searchsorted(used, j)].astype(np.int64)
    # |A n B| / |A u B| >= t without a division
    return common * (1 + threshold) >= threshold * (size[i] + size[j]) - 1e-9


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """One (node, root) per node that is not its tree's root."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, r) for x in range(n) if (r := find(x)) != x]


def in_first_bucket(sig: np.ndarray, mask: np.ndarray, t: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs of rows in a bucket of band ``t``: whether no bucket of a lesser band has both.
    ``mask``: the bands in which a row has a bucket."""
    keep = np.zeros(len(i), bool)
    bit = np.int64(1) << np.arange(BANDS, dtype=np.int64)
    for lo in range(0, len(i), 1 << 14):
        a, b = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
        same = (sig[a] == sig[b]).reshape(-1, BANDS, ROWS).all(2)
        same &= ((mask[a] & mask[b])[:, None] & bit) != 0
        keep[lo : lo + (1 << 14)] = same[:, t] & ~same[:, :t].any(1)
    return keep


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = tk.column_bytes(b, "text")
        ids, n, sigs = [], [], []
        for lo, hi in tk.slices([len(t or b"") for t in texts]):
            for s in tk.shingle_sets(texts[lo:hi], WIDTH):
                ids.append(class_key(s))
                n.append(len(s))
                sigs.append(signature(s).tobytes() if len(s) else None)
        size = [len(t or b"") for t in texts]
        yield tk.replace_columns(b, ["doc_id", "th1", "th2"], cid=pa.array(ids, pa.binary()), n_shingles=pa.array(n, pa.int64()), n_bytes=pa.array(size, pa.int64()), sig=pa.array(sigs, pa.binary()))


MEETING = ("task", "cid", "side", "alone", "band", "mask", "sig")


class Meeting:
    """The rows of one task: the classes of one block, or of two."""

    def __init__(self, task: int):
        self.task, self.rows, self.seen = task, [], set()

    def add(self, row: tuple) -> None:
        """``row``: the columns of MEETING, and what else belongs to the class."""
        if row[1] not in self.seen:
            self.seen.add(row[1])
            self.rows.append(row)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.rows) < 2:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        sig = np.frombuffer(b"".join(r[6] for r in self.rows), np.uint16).reshape(-1, HASHES)
        side = np.array([r[2] for r in self.rows])
        i, j = surviving_pairs(sig, np.flatnonzero(side == 0), None if self.rows[0][3] else np.flatnonzero(side == 1))
        if self.rows[0][4] is not None and len(i):
            ok = in_first_bucket(sig, np.array([r[5] for r in self.rows], np.int64), self.rows[0][4], i, j)
            i, j = i[ok], j[ok]
        return i, j


def _meetings(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[Meeting]:
    """Rows come sorted by task."""
    held: Meeting | None = None
    for b in batches:
        cols = [b.column(b.schema.get_field_index(k)).to_pylist() for k in (*MEETING, *more)]
        for row in zip(*cols, strict=True):
            if held is not None and held.task != row[0]:
                yield held
                held = None
            held = held or Meeting(row[0])
            held.add(row)
    if held is not None:
        yield held


def _table(rows: list[tuple], *columns: tuple[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns)], names=[n for n, _ in columns])


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes of each task that have a pair left, by signatures alone."""
    for m in _meetings(batches):
        i, j = m.pairs()
        rows = [m.rows[x][:6] for x in np.unique(np.concatenate([i, j])).tolist()]
        if rows:
            yield _table(rows, ("task", pa.int64()), ("cid", pa.binary()), ("side", pa.int32()), ("alone", pa.bool_()), ("band", pa.int32()), ("mask", pa.int64()))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links and trees of each task's classes, by shingles."""

    def known(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose text is of their class; its shingles in place of the text."""
        for b in rows:
            texts, cids = tk.column_bytes(b, "text"), b.column(b.schema.get_field_index("cid")).to_pylist()
            for lo, hi in tk.slices([len(t or b"") for t in texts]):
                sets = tk.shingle_sets(texts[lo:hi], WIDTH)
                own = [class_key(s) == c for s, c in zip(sets, cids[lo:hi], strict=True)]
                part = b.slice(lo, hi - lo).drop_columns(["text"]).append_column("set", pa.array([s.tobytes() for s in sets], pa.binary()))
                yield part.filter(pa.array(own))

    for m in _meetings(known(batches), "members", "set"):
        i, j = m.pairs()
        sets = [np.frombuffer(r[-1], np.uint64) for r in m.rows]
        ok = verify(sets, i, j)
        i, j = i[ok], j[ok]
        links, weight = np.zeros(len(sets), np.int64), np.array([r[-2] for r in m.rows], np.int64)
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        tree = dict(forest(len(sets), i, j))
        rows = [(m.rows[x][1], m.rows[tree[x]][1] if x in tree else None, int(links[x])) for x in np.flatnonzero(links).tolist()]
        if rows:
            yield _table(rows, ("cid", pa.binary()), ("peer", pa.binary()), ("links", pa.int64()))


def _buckets(classes: DataFrame) -> DataFrame:
    """``cid, bucket, band, mask, blocks``: the classes of every bucket that has several; a null band
    says that the bucket is a component of others."""
    band = classes.select("node", F.posexplode(band_keys()).alias("band", "key"))
    own = F.xxhash64("node")
    shared = band.groupBy("key").agg(F.min("band").alias("band"), F.min("node").alias("hub"), F.max("node").alias("far"), F.count("*").alias("n"), F.bit_xor(own).alias("x"), F.bit_xor(F.xxhash64(own, F.lit(1))).alias("y")).where("hub <> far")
    # buckets of equal members: the first stands for all
    kept = shared.groupBy("hub", "far", "n", "x", "y").agg(F.min(F.struct("band", "key")).alias("b")).select("b.key", "hub", "n")
    kept = materialise(kept, "kept")
    n_kept, rows, most = kept.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    written = materialise(may_have(band, kept, "key", n_kept), "bands")
    members = materialise(looked_up(written, kept, ["key"], "n", rows, most), "members")
    discard(written)
    groups = materialise(components(members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))), "groups")
    size = groups.groupBy("component").agg(F.count("*").cast("double").alias("size"))
    # comparisons of a component's buckets against those of the whole
    cost = kept.join(groups, F.col("hub") == F.col("node")).groupBy("component").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("cost"))
    whole = size.join(cost, "component").select("component", (F.col("size") * F.col("size") <= F.col("cost")).alias("whole"), F.col("size").cast("bigint").alias("size"))
    whole = materialise(whole, "sizes")
    most = whole.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    whole = materialise(looked_up(groups, whole, ["component"], "size", groups.count(), most).select("node", "component", "whole"), "wholes")
    discard(groups)
    none = F.lit(None)
    once = whole.where("whole").select("node", F.col("component").alias("bucket"), none.cast("int").alias("band"), none.cast("bigint").alias("mask"))
    split = members.join(whole.where("not whole").select("node"), "node", "left_semi")
    bits = split.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("mask"))
    each = split.join(bits, "node").select("node", F.col("key").alias("bucket"), F.col("band").cast("int").alias("band"), "mask")
    rows = once.unionByName(each).join(classes.select("node", "cid", "n_bytes"), "node")
    rows = materialise(rows.select("cid", "n_bytes", F.xxhash64("bucket", "band").alias("bucket"), "band", "mask"), "buckets")
    for spent in (kept, members, whole):
        discard(spent)
    blocks = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    blocks = materialise(blocks, "blocks")
    n, most = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    return looked_up(rows, blocks, ["bucket"], "size", n, most).select("cid", "bucket", "band", "mask", "blocks")


def _tasks(rows: DataFrame) -> DataFrame:
    """A row for every meeting of its block: alone, or as the lower or the upper of two."""
    block = F.pmod(F.xxhash64("cid"), F.col("blocks").cast("bigint")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(block, o).alias("lo"), F.greatest(block, o).alias("hi"), (block > o).cast("int").alias("side")))
    return rows.withColumn("meet", F.explode(meets)).select(F.xxhash64("bucket", "meet.lo", "meet.hi").alias("task"), "cid", "meet.side", (F.col("meet.lo") == F.col("meet.hi")).alias("alone"), "band", "mask", "sig")


def _by_task(rows: DataFrame) -> DataFrame:
    return rows.repartition("task").sortWithinPartitions("task")


def _text_hash() -> list:
    return [F.xxhash64(F.lit(k), F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull()).alias(f"th{k}") for k in (1, 2)]


def _resolved(docs: DataFrame) -> DataFrame:
    """``doc_id, th1, th2`` (which name a row, but for repeats), ``n_shingles, copies, n_links, first``:
    the least row (with an id, if any has one) of all that are joined with this one."""
    ensure_workers(docs.sparkSession)
    base = docs.select("doc_id", "text", *_text_hash())
    feats = materialise(base.mapInArrow(tk.lean(_features), "doc_id bigint, th1 bigint, th2 bigint, cid binary, n_shingles bigint, n_bytes bigint, sig binary"), "shingles")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th1", "th2")
    # buckets work on the first half of the class key: a clash there only widens one
    half = F.conv(F.hex(F.substring("cid", 1, 8)), 16, -10).cast("bigint")
    classes = feats.where("cid is not null").groupBy("cid").agg(F.min(row).alias("rep"), F.count("*").alias("members"), F.max("n_bytes").alias("n_bytes"), F.first("sig").alias("sig"))
    classes = materialise(classes.withColumn("node", half), "classes")
    buckets = _buckets(classes)
    signed = _by_task(_tasks(buckets.join(classes.select("cid", "sig"), "cid")))
    left = materialise(signed.mapInArrow(tk.lean(_survivors), "task bigint, cid binary, side int, alone boolean, band int, mask bigint"), "survivors")
    # texts of the classes that are left, each looked for once
    meets = left.groupBy("cid").agg(F.collect_list(F.struct("task", "side", "alone", "band", "mask")).alias("meets"))
    chosen = materialise(classes.join(meets, "cid").select("rep.doc_id", "rep.th1", "rep.th2", "cid", "members", "sig", "meets"), "chosen")
    base = may_have(base, chosen, "th1", chosen.count())
    if repeats(feats):  # equal rows would all follow their class into one task
        base = base.dropDuplicates(["doc_id", "th1", "th2"])
    rows = base.join(chosen, (base.th1 == chosen.th1) & (base.th2 == chosen.th2) & base.doc_id.eqNullSafe(chosen.doc_id)).select("cid", "members", "sig", "text", F.explode("meets").alias("meet"))
    rows = _by_task(rows.select("meet.*", "cid", "members", "sig", "text"))
    found = materialise(rows.mapInArrow(tk.lean(_linked), "cid binary, peer binary, links bigint"), "links")
    discard(left)
    discard(chosen)
    tree = components(found.where("peer is not null").select(F.hex("cid").alias("a"), F.hex("peer").alias("b")))
    degree = found.groupBy("cid").agg(F.sum("links").alias("links"))
    per_class = classes.drop("sig").select("cid", "rep", "members").join(degree, "cid", "left").join(tree, F.hex("cid") == F.col("node"), "left")
    least = per_class.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    per_class = per_class.join(least, "component", "left").select("cid", (F.col("members") - 1).alias("copies"), F.coalesce("least", "rep").alias("first"), F.coalesce("links", F.lit(0)).alias("links"))
    none = F.lit(0).cast("bigint")
    out = feats.drop("sig").join(per_class, "cid", "left")
    return out.select("doc_id", "th1", "th2", "n_shingles", F.coalesce("copies", none).alias("copies"), (F.coalesce("copies", none) + F.coalesce("links", none)).alias("n_links"), F.coalesce("first", row).alias("first"))


def repeats(rows: DataFrame) -> bool:
    """Whether a row (id and text) occurs twice."""
    return bool(rows.groupBy("doc_id", "th1", "th2").count().where("count > 1").limit(1).count())


def links(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, class_id, n_copies, n_links``.

    ``class_id``: least doc_id of the documents joined by links or by equal shingle sets, directly
    or through others; ``n_copies``: other rows of the same set; ``n_links``: other rows linked,
    copies included. A text of fewer than five words is one shingle; null texts and texts without
    words have none, are joined to nothing and are a class of their own. Repeated rows are copies;
    rows with a null doc_id take part, and a class of such rows alone has a null class_id.
    """
    return _resolved(docs).select("doc_id", "n_shingles", F.col("first.doc_id").alias("class_id"), F.col("copies").alias("n_copies"), "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each joined group stays: the one of least doc_id (rows without an id come
    last, rows of one id in order of a hash of the text). Documents without words all stay."""
    found = materialise(_resolved(docs).where("n_links > 0"), "joined")
    lost = found.where("not (doc_id <=> first.doc_id and th1 = first.th1 and th2 = first.th2)").select("doc_id", "th1", "th2").distinct()
    again = repeats(found)
    asked = materialise(lost.union(found.select("doc_id", "th1", "th2")) if again else lost, "lost")
    marked = packed(docs, "doc_id", "text")
    marked = marked.withColumns({f"__{c}": h for c, h in zip(("th1", "th2"), _text_hash(), strict=True)})

    def on(other: DataFrame):
        return (marked["__th1"] == other.th1) & (marked["__th2"] == other.th2) & marked.doc_id.eqNullSafe(other.doc_id)

    # texts that a sieve clears need no join: only the others are shuffled
    flagged = sieved(marked, asked.withColumnRenamed("th1", "__th1"), "__th1", asked.count())
    clear, marked = flagged.where("not __may").drop("__may"), flagged.where("__may").drop("__may")
    left = marked.join(lost, on(lost), "left_anti")
    if again:
        twice = found.groupBy("doc_id", "th1", "th2").count().where("count > 1")
        once = left.join(twice, on(twice), "left_semi").dropDuplicates(["doc_id", "__th1", "__th2"])
        left = left.join(twice, on(twice), "left_anti").unionByName(once)
    return unpacked(left.unionByName(clear), docs.columns, "doc_id", "text")

"""Secret scans over an incremental ledger of blobs.

Every version of a text is a blob, named by the SHA-256 of its content. The ledger holds, for each
blob and version of the rules, what was found; only pairs it lacks are scanned, each once however
many paths hold the blob, and findings are joined back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import ensure_workers, in_few_files, looked_up, materialise, unclashing

RULES_VERSION = "base-1"
#: Spans of a hot blob that may be broadcast.
SHORT_BYTES = 1 << 16
#: Commits that the query deals its documents to.
COMMITS = 3
# The kinds in order, their patterns and least lengths (of group 2, the match, the match).
KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN), re.compile(ACCESS), re.compile(HEX)


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start and then kind; code points, end exclusive."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


LEDGER = "blob string, rules string, spans string, n_assign bigint, n_access bigint, n_hex bigint"


def _scan_blobs(rules: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs, texts = (b.column(b.schema.get_field_index(k)) for k in ("blob", "text"))
            spans, counts = [], []
            for t in texts:  # one is decoded at a time: a string takes up to four bytes a character
                found = scan(t.as_py() or "")
                spans.append(",".join(f"{k}:{s}:{e}" for s, e, k in found))
                counts.append([sum(k == kind for _, _, k in found) for kind in KINDS])
            cols = [blobs.cast(pa.string()), pa.array([rules] * len(blobs), pa.string()), pa.array(spans, pa.string())]
            cols += [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(cols, names=["blob", "rules", "spans", "n_assign", "n_access", "n_hex"])

    return run


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def blob_of(text="text"):
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"), 256)


def unseen(paths: DataFrame, ledger: DataFrame | None, rules: str = RULES_VERSION) -> DataFrame:
    """``blob, text``: each blob of ``paths`` once that the ledger lacks under ``rules``."""
    rows = paths.select(blob_of().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    # partial aggregation leaves one copy per task before anything is shuffled, so a text that a
    # third of the paths hold is not a hot key; the ledger is met in the same partitions
    rows = rows.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        rows = rows.join(ledger.where(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    return rows


def update(paths: DataFrame, ledger: DataFrame | None = None, rules: str = RULES_VERSION) -> DataFrame:
    """The entries to add to the ledger, written to the shared folder: one per unseen blob."""
    ensure_workers(paths.sparkSession)
    return materialise(in_few_files(unseen(paths, ledger, rules).mapInArrow(tk.lean(_scan_blobs(rules)), LEDGER), paths), "ledger")


def findings(paths: DataFrame, ledger: DataFrame, rules: str = RULES_VERSION, keep: list[str] | None = None) -> DataFrame:
    """Findings of every path from the ledger: ``keep`` columns (doc_id by default), ``blob``,
    ``spans`` and counts; kept columns of these names give way. A null text is the empty blob;
    repeated paths each get their row; a blob that the ledger lacks gets nulls. A blob of very many
    paths is looked up by broadcast, if its spans take no more than ``SHORT_BYTES``; else by a shuffle."""
    added = ["blob", "spans", *(f"n_{k}" for k in KINDS)]
    keep = unclashing(keep or ["doc_id"], *added, "__paths")
    at = materialise(paths.select(*keep, blob_of().alias("blob")), "paths")
    entries = ledger.where(F.col("rules") == rules).drop("rules")
    hits = entries.groupBy("blob").agg(F.first("spans").alias("spans"), *[F.first(f"n_{k}").alias(f"n_{k}") for k in KINDS])
    held = at.groupBy("blob").agg(F.count("*").alias("__paths"))
    held = held.join(hits, "blob", "left")
    # of fewer than a thousand hot blobs, so no more than 64 MB are broadcast
    short = F.coalesce(F.octet_length("spans"), F.lit(0)) <= SHORT_BYTES
    held = materialise(in_few_files(held.withColumn("__paths", F.when(short, F.col("__paths")).otherwise(F.lit(0))), paths), "held")
    n, most = held.agg(F.coalesce(F.sum("__paths"), F.lit(0)), F.coalesce(F.max("__paths"), F.lit(0))).first()
    found = looked_up(at, held, ["blob"], "__paths", n, most)
    return found.select(*keep, *added)


def committed(paths: DataFrame, commits: int) -> list[DataFrame]:
    """A history: the paths in the order in which they came, a hash of their id deciding."""
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(commits))
    return [paths.where(turn == c) for c in range(commits)]


def report(docs: DataFrame, commits: int = COMMITS) -> DataFrame:
    """One row per document. ``docs`` come in ``commits`` one after the other; each is scanned against
    the ledger that those before it left, so a blob of several commits is scanned in the first
    alone. The result is that of one scan of all."""
    ledger = None
    for part in committed(docs, commits):
        new = update(part, ledger)
        ledger = new if ledger is None else ledger.union(new)
    found = in_few_files(findings(docs, ledger), docs)
    spans = F.coalesce("spans", F.lit(""))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))

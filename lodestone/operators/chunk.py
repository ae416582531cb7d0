"""Chunking operators: one document to many rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..config import DEFAULTS, Settings
from ..functions import split as sp
from ..functions import structure
from ..session import ensure_workers
from ..sources import files as src

CHUNK = "chunk_index int, total int, section string, kind string, name string, element_type string, fallback_reason string, content string"


def _flat_map(df: DataFrame, keys: list[str], schema: str, fn) -> DataFrame:
    """Rows that ``fn(row) -> list of tuples`` gives for each row, below its keys, which pass as they
    are, null or not."""
    ensure_workers(df.sparkSession)
    fields = T._parse_datatype_string(schema).fields
    arrow = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            found = [fn(dict(zip(names, row, strict=True))) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            at = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            flat = [t for rows in found for t in rows]
            cols = [b.column(names.index(k)).take(at) for k in keys]
            cols += [pa.array([t[i] for t in flat], kind) for i, kind in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, *(f.name for f in fields)])

    return df.mapInArrow(run, T.StructType([*df.select(*keys).schema.fields, *fields]))


def prose_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = DEFAULTS) -> DataFrame:
    """``key, chunk_index, total, content`` by the recursive splitter; blank and null texts have none."""
    size, overlap = settings.chunk_size, settings.chunk_overlap

    def split(row: dict) -> list[tuple]:
        parts = sp.split_text(row[text] or "", size, overlap)
        return [(i, len(parts), p) for i, p in enumerate(parts)]

    return _flat_map(docs.select(key, text), [key], "chunk_index int, total int, content string", split)


def line_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, chunk_index, total, content``: non-blank lines, numbered without a window."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.trim(x) != "")
    return docs.select(key, lines.alias("__l")).select(key, F.size("__l").alias("total"), F.posexplode("__l").alias("chunk_index", "content"))


def prose_header(title: Column, section: Column, source: Column, folder: Column, author: Column, modified: Column, position: Column, total: Column) -> Column:
    """The bracket line above a prose chunk; parts that are empty are left out."""
    part = lambda label, c, *none: F.when(~F.coalesce(c, F.lit("")).isin("", *none), F.concat(F.lit(label + ": "), c))
    parts = [
        part("Document", title),
        part("Section", section),
        part("Source", source, "manual", "upload"),
        part("Path", folder, "/"),
        part("Author", author),
        part("Modified", F.substring(modified, 1, 10)),
        F.concat(F.lit("Part "), position.cast("string"), F.lit(" of "), total.cast("string")),
    ]
    return F.concat(F.lit("["), F.concat_ws(" | ", *parts), F.lit("]\n"))


def pipe_row(columns: dict[str, Column]) -> Column:
    """``k: v | k: v`` of the cells that have text, each on one line."""
    cells = []
    for name, c in columns.items():
        flat = F.trim(F.translate(c.cast("string"), "\n\r", "  "))
        cells.append(F.when(flat != "", F.concat(F.lit(name + ": "), flat)))
    return F.concat_ws(" | ", *cells)


def structured_chunks(files: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Chunks of ``files(path, format, doc_type, source, folder_path, content)`` other than prose and CSV."""

    def split(row: dict) -> list[tuple]:
        meta = {"source": row["source"], "folder_path": row["folder_path"], "doc_type": row["doc_type"]}
        name = row["path"].rstrip("/").rsplit("/", 1)[-1]
        return [(c.position - 1, c.total, c.section, c.kind, c.name, c.element_type, c.fallback_reason, c.text) for c in structure.chunk_structured(row["content"] or "", row["format"], name, meta, settings.chunk_size, settings.chunk_overlap)]

    return _flat_map(files, ["path"], CHUNK, split)


def csv_chunks(files: DataFrame) -> DataFrame:
    """One chunk per row with content of ``files(path, source, folder_path, content)``."""

    def split(row: dict) -> list[tuple]:
        name = row["path"].rstrip("/").rsplit("/", 1)[-1]
        return structure.csv_rows(row["content"] or "", name, {"source": row["source"], "folder_path": row["folder_path"]})

    return _flat_map(files, ["path"], "csv_row_index int, total_rows int, content string", split)


def element_chunks(files: DataFrame, settings: Settings = DEFAULTS, parsers: Mapping[str, src.Parser] | None = None) -> DataFrame:
    """Chunks of the prose ``files(path, source, folder_path, content)``: the texts of a file's elements,
    joined by blank lines and split; the section is the titles that a chunk starts with, the element
    type lists those of the file. Files without elements have none: see :func:`src.unparsed`."""
    size, overlap = settings.chunk_size, settings.chunk_overlap
    known = {**src.PARSERS, **(parsers or {})}

    def split(row: dict) -> list[tuple]:
        found, _ = src.elements_of(row["path"], row["content"], known)
        titles = frozenset(text for kind, text in found if kind == "Title")
        kinds = ",".join(sorted({kind for kind, _ in found}))
        parts = sp.split_text("\n\n".join(text for _, text in found), size, overlap)
        return [(i, len(parts), sp.section_of(p, titles), kinds, p) for i, p in enumerate(parts)]

    keys = ["path", "source", "folder_path"]
    return _flat_map(files.select(*keys, F.col("content").cast("binary").alias("content")), keys, "chunk_index int, total int, section string, element_type string, content string", split)


def chunk_files(files: DataFrame, settings: Settings = DEFAULTS, parsers: Mapping[str, src.Parser] | None = None) -> DataFrame:
    """Every file by its format: prose by elements and characters, CSV by rows, all else by structure.

    ``files(path, format, doc_type, source, folder_path, content)``, content as bytes or text; returns
    :data:`CHUNK` below path. ``parsers``: more than, or in place of, those of :data:`src.PARSERS`."""
    none = F.lit(None).cast("string")
    prose = element_chunks(files.where("format = 'prose'"), settings, parsers)
    title = F.substring_index("path", "/", -1)
    head = prose_header(title, F.col("section"), F.col("source"), F.col("folder_path"), none, none, F.col("chunk_index") + 1, F.col("total"))
    prose = prose.select("path", "chunk_index", "total", "section", none.alias("kind"), none.alias("name"), "element_type", none.alias("fallback_reason"), F.concat(head, "content").alias("content"))
    texts = src.as_text(files) if dict(files.dtypes)["content"] == "binary" else files
    rows = csv_chunks(texts.where("format = 'csv'")).select("path", F.col("csv_row_index").alias("chunk_index"), F.col("total_rows").alias("total"), F.lit("").alias("section"), none.alias("kind"), none.alias("name"), F.lit("csv_row").alias("element_type"), none.alias("fallback_reason"), "content")
    rest = structured_chunks(texts.where("format not in ('prose', 'csv')"), settings)
    return prose.unionByName(rows).unionByName(rest)

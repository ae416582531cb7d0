"""Files as DataFrames: walking, decoding, classifying, parsing."""

from __future__ import annotations

import email
import email.policy
import os
import re
from collections.abc import Callable, Iterator, Mapping
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as cl
from ..functions import structure
from ..functions import tables as t
from ..session import ensure_workers


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, modified, size_bytes, content`` (bytes) of every file below ``root``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(F.col("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"), "content")


def supported(files: DataFrame) -> DataFrame:
    """Files of a walk that can be taken: known extension, or Terraform's JSON, outside skipped folders."""
    skip = "/(" + "|".join(x.replace(".", r"\.") for x in t.SKIPPED_FOLDERS) + ")/"
    known = cl.suffix(cl.file_name(F.col("path"))).isin(*t.UPLOAD_EXTENSIONS) | F.lower("path").endswith(".tf.json")
    return files.where(~F.col("path").rlike(skip) & known)


def skipped_count(files: DataFrame) -> DataFrame:
    """One row: how many files a walk takes and how many it leaves."""
    taken = supported(files).select(F.lit(True).alias("taken"), "path")
    return files.join(taken, "path", "left").agg(F.count_if("taken").alias("taken"), F.count_if(F.col("taken").isNull()).alias("skipped"))


def as_text(files: DataFrame) -> DataFrame:
    """Bytes as UTF-8, with a byte order mark gone and malformed bytes replaced."""
    return files.withColumn("content", F.regexp_replace(F.expr("make_valid_utf8(string(content))"), "^﻿", ""))


def classified(files: DataFrame, *hints: str) -> DataFrame:
    """Add ``format`` and ``doc_type``; ``hints``: columns asked, in order, where the path tells nothing."""
    path = F.col("path")
    return files.withColumns({"format": cl.format_of(path), "doc_type": cl.doc_type_of(path, *[F.col(h) for h in hints])})


class _Elements(HTMLParser):
    """Titles, paragraphs, list items and tables of a page, in order."""

    BLOCKS = {**{f"h{i}": "Title" for i in range(1, 7)}, "title": "Title", "p": "NarrativeText", "li": "ListItem", "header": "Header", "footer": "Footer"}
    DROPPED = ("script", "style", "noscript", "template")
    CELLS = ("tr", "td", "th")

    def __init__(self, shown: frozenset[tuple[int, int]] = frozenset()):
        """``shown``: where elements start that are not dropped after all."""
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.kind, self.text, self.table, self.flat, self.depth = None, [], [], [], 0
        self.shown, self.hidden = shown, []
        self.rest, self.rows = (0, 0, 0), (0, 0)  # where a table that never ends stops being one

    def _close(self) -> None:
        words = " ".join("".join(self.text).split())
        if words:
            self.out.append((self.kind or t.OTHER_ELEMENT, words))
        self.kind, self.text = None, []

    def _close_table(self, tags: int | None = None, words: int | None = None) -> None:
        text = structure.table_markdown("".join(self.table[:tags])) or " ".join(" ".join(self.flat[:words]).split())
        if text:
            self.out.append(("Table", text))
        self.table, self.flat, self.depth = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in self.DROPPED:
            if self.getpos() not in self.shown:
                self.hidden.append((tag, self.getpos()))
        elif tag == "table":
            if not self.depth:
                self._close()
                self.rest, self.rows = (*self.getpos(), len(self.get_starttag_text())), (0, 0)
            self.depth += 1
        if self.depth:
            self.table.append(f"<{tag}>")
        elif tag in self.BLOCKS:
            self._close()
            self.kind = self.BLOCKS[tag]
        elif tag in self.CELLS:
            self._close()

    def handle_endtag(self, tag):
        if tag in self.DROPPED:
            at = next((i for i in reversed(range(len(self.hidden))) if self.hidden[i][0] == tag), None)
            if at is not None:
                del self.hidden[at:]
        if self.depth:
            self.table.append(f"</{tag}>")
            if tag == "tr" and self.depth == 1:
                self.rest, self.rows = (*self.getpos(), 0), (len(self.table), len(self.flat))
            if tag == "table":
                self.depth -= 1
                if not self.depth:
                    self._close_table()
        elif tag in self.BLOCKS or tag in ("div", "article", "section", "nav", "body"):
            self._close()

    def handle_data(self, data):
        if self.hidden:
            return
        (self.table if self.depth else self.text).append(data)
        if self.depth:
            self.flat.append(data)


def html_elements(html: str) -> list[tuple[str, str]]:
    """(element type, text) of a page, in order; tables as Markdown, or as text where that is empty;
    empty elements left out.

    A table that never ends has the rows that ended, and the page goes on behind them; a noscript or
    template that never ends hides nothing."""
    out: list[tuple[str, str]] = []
    while True:
        parser = _Elements()
        parser.feed(html)
        parser.close()
        shown = frozenset(at for tag, at in parser.hidden if tag in ("noscript", "template"))
        if shown:
            parser = _Elements(shown)
            parser.feed(html)
            parser.close()
        if not parser.depth:
            parser._close()
            return out + parser.out
        line, column, skip = parser.rest
        parser._close_table(*parser.rows)
        out += parser.out
        html = html.split("\n", line - 1)[-1][column + skip :]


def parsed_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, pos, element_type, text``: one row per element of each page."""
    ensure_workers(pages.sparkSession)
    kind = dict(pages.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, i, e, x) for k, h in zip(pdf[key], pdf[html], strict=True) for i, (e, x) in enumerate(html_elements(h or ""))]
            yield pd.DataFrame(rows, columns=[key, "pos", "element_type", "text"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, pos int, element_type string, text string")


# Marks of Markdown and reStructuredText.
_LINES = re.compile(r"\r\n|\r|\n")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r" {0,3}(?:=+|-{2,})[ \t]*$")
_ITEM = re.compile(r"\s*(?:[-*+]|\d{1,9}[.)])[ \t]+\S")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_ADORNMENT = re.compile(r"([!-/:-@\[-`{-~])\1+\s*$")
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.IGNORECASE)


def text_elements(text: str) -> list[tuple[str, str]]:
    """Paragraphs of a plain text, cut at blank lines."""
    return [("NarrativeText", p.strip()) for p in re.split(r"\n\s*\n", "\n".join(_LINES.split(text))) if p.strip()]


def markdown_elements(text: str) -> list[tuple[str, str]]:
    """Titles without their marks; paragraphs, list items, tables and fenced blocks as they are written."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    kind, fence = "NarrativeText", ""

    def close() -> None:
        nonlocal kind
        words = "\n".join(held).strip()
        if words:
            out.append((kind, words))
        held.clear()
        kind = "NarrativeText"

    lines = _LINES.split(text)
    if lines[0].rstrip() == "---" and "---" in (x.rstrip() for x in lines[1:]):
        end = next(i for i, x in enumerate(lines[1:], 1) if x.rstrip() == "---")
        held += lines[1:end]
        kind = t.OTHER_ELEMENT
        close()
        lines = lines[end + 1 :]
    for line in lines:
        if fence:
            held.append(line)
            mark = line.strip()
            if mark.startswith(fence) and not mark.strip(fence[0]):
                fence = ""
                close()
        elif mark := _FENCE.match(line):
            close()
            kind, fence = t.OTHER_ELEMENT, mark[1]
            held.append(line)
        elif head := _HEADING.match(line):
            close()
            if head[1]:
                out.append(("Title", head[1].strip()))
        elif not line.strip():
            close()
        elif kind == "NarrativeText" and len(held) == 1 and _UNDERLINE.match(line):
            kind = "Title"
            close()
        elif _ITEM.match(line):
            close()
            kind = "ListItem"
            held.append(line)
        else:
            row = line.lstrip().startswith("|")
            if row != (kind == "Table"):
                close()
                kind = "Table" if row else kind
            held.append(line)
    close()
    return out


def rst_elements(text: str) -> list[tuple[str, str]]:
    """Titles by their underlines, which go; paragraphs as they are written."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    for line in [*_LINES.split(text), ""]:
        over = len(held) == 2 and _ADORNMENT.match(held[0])
        if (len(held) == 1 or over) and not _ADORNMENT.match(held[-1]) and _ADORNMENT.match(line) and len(line.rstrip()) >= len(held[-1].rstrip()):
            out.append(("Title", held[-1].strip()))
            held = []
        elif line.strip():
            held.append(line)
        else:
            out += text_elements("\n".join(held))
            held = []
    return out


def decoded(raw: bytes) -> str:
    """UTF-8; a page that is not and names another charset, in that; malformed bytes replaced."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        named = _CHARSET.search(raw[:2048])
        try:
            return raw.decode(named[1].decode() if named else "utf-8", "replace").removeprefix("\ufeff")
        except LookupError:
            return raw.decode("utf-8", "replace").removeprefix("\ufeff")


def mail_elements(raw: bytes) -> list[tuple[str, str]]:
    """The subject as a title and the body of a mail; its attachments are files of their own."""
    mail = email.message_from_bytes(raw, policy=email.policy.default)
    body = mail.get_body(("html", "plain"))
    subject = str(mail["subject"] or "").strip()
    found = [] if body is None else (html_elements if body.get_content_subtype() == "html" else text_elements)(body.get_content())
    return ([("Title", subject)] if subject else []) + found


Parser = Callable[[bytes], list[tuple[str, str]]]
#: Extension to parser: bytes to (element type, text) in order. Office and PDF parsers are put in here or
#: given to a plan by whoever has a library for them.
PARSERS: dict[str, Parser] = {
    ".html": lambda raw: html_elements(decoded(raw)),
    ".htm": lambda raw: html_elements(decoded(raw)),
    ".md": lambda raw: markdown_elements(decoded(raw)),
    ".markdown": lambda raw: markdown_elements(decoded(raw)),
    ".rst": lambda raw: rst_elements(decoded(raw)),
    ".eml": mail_elements,
}
# Extensions of files that are no text; without a parser they are refused.
NO_TEXT = (".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".rtf")


def elements_of(path: str, raw: bytes | None, parsers: Mapping[str, Parser]) -> tuple[list[tuple[str, str]], str | None]:
    """Elements of a prose file, empty ones left out, and why there are none."""
    ext = os.path.splitext(path)[1].lower()
    if ext in NO_TEXT and ext not in parsers:
        return [], f"no parser for {ext}"
    try:
        found = parsers[ext](bytes(raw or b"")) if ext in parsers else text_elements(decoded(bytes(raw or b"")))
    except Exception as e:  # a parser may fail with anything; the file is refused, the others go on
        return [], f"parser failed: {type(e).__name__}"
    found = [(kind, text.strip()) for kind, text in found if text and text.strip()]
    return found, None if found else "no content extracted"


def unparsed(files: DataFrame, parsers: Mapping[str, Parser] | None = None) -> DataFrame:
    """``path, reason`` of those of ``files(path, content)``, prose, that have no elements."""
    ensure_workers(files.sparkSession)
    known = {**PARSERS, **(parsers or {})}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(p, elements_of(p, c, known)[1]) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["path", "reason"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(run, "path string, reason string")


def raw_text(spark: SparkSession, text: str, filename: str = "manual_input.txt") -> DataFrame:
    """One text as a parsed document of one element; a blank one is an error."""
    if not text.strip():
        raise ValueError("the text is empty")
    return spark.createDataFrame([(filename, 0, "NarrativeText", text.strip())], "filename string, pos int, element_type string, text string")

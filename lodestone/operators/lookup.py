"""Rows by key, and by a value inside their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(rows: DataFrame, **key: object) -> DataFrame:
    """The rows whose columns have these values: a filter that the scan takes; none if there is no
    such row."""
    for name, value in key.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def json_is(document: Column, path: str, value: str) -> Column:
    """Whether the text at ``path`` (``$.a.b``) of a JSON document is ``value``; false where the path,
    or the document, is not there."""
    return F.coalesce(F.get_json_object(document, path) == F.lit(value), F.lit(False))

"""Incremental synchronisation of a source listing against what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN_ERRORS = 20


def actions(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """``file_id, action`` of every listed file: unchanged, changed or new. Files that have vanished
    are left alone. Any difference of the time, older or newer, is a change; null equals ''.

    ``stored(file_id, last_modified)``: of repeated ids the greatest time counts."""
    have = stored.groupBy("file_id").agg(F.max(F.coalesce("last_modified", F.lit(""))).alias("had"))
    same = F.coalesce("last_modified", F.lit("")) == F.col("had")
    return listing.join(have, "file_id", "left").select("file_id", F.when(F.col("had").isNull(), "new").when(same, "unchanged").otherwise("changed").alias("action"))


def summary(done: DataFrame) -> DataFrame:
    """One row of counters. ``done(action, error)``: error null where all went well."""
    ok = F.col("error").isNull()
    return done.agg(
        F.count("*").alias("total"),
        F.count_if(ok & (F.col("action") == "new")).alias("added"),
        F.count_if(ok & (F.col("action") == "changed")).alias("updated"),
        F.count_if(ok & (F.col("action") == "unchanged")).alias("skipped"),
        F.count_if(~ok).alias("failed"),
    )


def replaced(stored: DataFrame, fresh: DataFrame, act: DataFrame) -> DataFrame:
    """The next snapshot: rows of changed files give way to fresh ones, in one write by the caller,
    so that a failure in between loses nothing. ``stored`` and ``fresh`` share file_id and columns."""
    touched = act.where("action in ('changed', 'new')").select("file_id")
    return stored.join(touched, "file_id", "left_anti").unionByName(fresh.join(touched, "file_id", "left_semi"))


def first_errors(done: DataFrame) -> DataFrame:
    """A report's errors: the first few by file."""
    return done.where("error is not null").select("file_id", "error").orderBy("file_id").limit(SHOWN_ERRORS)

"""Incremental maintenance: manifest diffs and staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, status (new, changed, removed, same) of files(path, mtime, len) against the last manifest."""
    a = files.select("path", F.col("mtime").alias("m1"), F.col("len").alias("l1"), F.lit(True).alias("here"))
    b = manifest.select("path", F.col("mtime").alias("m0"), F.col("len").alias("l0"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "removed").when(F.col("m1").eqNullSafe(F.col("m0")) & F.col("l1").eqNullSafe(F.col("l0")), "same").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def stale(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: whether anything differs, and counts."""
    d = diff(files, manifest)
    n = lambda s: F.count_if(F.col("status") == s)
    return d.agg((F.count_if(F.col("status") != "same") > 0).alias("stale"), n("new").alias("n_new"), n("changed").alias("n_changed"), n("removed").alias("n_removed"), n("same").alias("n_same"))


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files to extract again."""
    return files.join(manifest.select("path", "mtime", "len"), ["path", "mtime", "len"], "left_anti")


def removed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(files.select("path"), "path", "left_anti")


def next_chunks(old: DataFrame, new: DataFrame, files: DataFrame, manifest: DataFrame) -> DataFrame:
    """The chunk table after a sync: rows of untouched files and the new rows of changed ones."""
    gone = diff(files, manifest).where("status IN ('changed', 'removed')").select("path")
    return old.join(gone, "path", "left_anti").unionByName(new)

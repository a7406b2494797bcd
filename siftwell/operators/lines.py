"""Exact search over lines, without an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.sources.workspace import until_nul


def line_array(content: Column | str) -> Column:
    """Lines without their ends; no empty last line; empty content has none."""
    c = F.col(content) if isinstance(content, str) else content
    parts = F.split(F.regexp_replace(c, r"\n\z", ""), "\n")
    parts = F.when(c.contains("\r"), F.transform(parts, lambda x: F.regexp_replace(x, r"\r\z", ""))).otherwise(parts)
    return F.when(F.length(c) > 0, parts).otherwise(F.array().cast("array<string>"))


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text."""
    return files.select("path", F.posexplode(line_array("content")).alias("i", "text")).select("path", (F.col("i") + 1).cast("long").alias("line"), "text")


def search(files: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = False, langs: list[str] = (), globs: list[str] = (), limit: int | None = 100) -> DataFrame:
    """Matching lines in path and line order. Path filters come before content is read into lines; files without the literal are dropped whole."""
    pattern = T.normalize_pattern(pattern)
    df = files.where(T.in_languages("path", list(langs))).where(T.keeps_globs("path", list(globs)))
    df = df.withColumn("content", until_nul("content"))
    if not pattern:
        df = df.limit(0)
    elif not regex:
        df = df.where(T.line_matches("content", pattern, False, ignore_case))
    hits = lines(df).where(T.line_matches("text", pattern or "x", regex, ignore_case))
    return hits if limit is None else hits.orderBy("path", "line").limit(T.clamp(limit, 500))


def fallback(files: DataFrame, terms: list[str], limit: int = 100) -> DataFrame:
    """Lines with any of the terms, in either case."""
    if not terms:
        return search(files, "", limit=limit)
    pattern = "|".join(T.quoted(t) for t in terms)
    return lines(files).where(F.col("text").rlike("(?iu)" + pattern)).orderBy("path", "line").limit(T.clamp(limit, 500))

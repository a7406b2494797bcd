"""Caller to callee chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import short_name, simple_name

CHAIN_CAP = 8000
DIVIDER = "\n// --- calls ---\n"


def resolve(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, caller, callee, target_path: the callee's own file first, else the only file that defines the name."""
    names = symbols.select("path", F.explode(F.array_distinct(F.array("name", short_name("name")))).alias("name")).distinct()
    local = names.select("path", F.col("name").alias("callee"), F.col("path").alias("local_path"))
    single = names.groupBy(F.col("name").alias("callee")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("global_path")).where("n = 1").drop("n")
    out = calls.select("path", "caller", "callee").distinct().join(local, ["path", "callee"], "left").join(single, "callee", "left")
    return out.select("path", "caller", "callee", F.coalesce("local_path", "global_path").alias("target_path")).where("target_path is not null")


def chain_chunks(resolved: DataFrame, chunks: DataFrame, cap: int = CHAIN_CAP) -> DataFrame:
    """One chunk for each caller and callee: both bodies with a divider; at most `cap`, in path and caller order."""
    symbols = chunks.where("kind = 'symbol'").select("path", "start", "end", "breadcrumb", "text", short_name(simple_name("breadcrumb")).alias("name"))
    a = symbols.select("path", F.col("breadcrumb").alias("caller"), "start", "end", F.col("text").alias("caller_text"))
    b = symbols.groupBy(F.col("path").alias("target_path"), F.col("name").alias("callee")).agg(F.min_by("text", F.struct("start", "end")).alias("callee_text"))
    out = resolved.join(a, ["path", "caller"]).join(b, ["target_path", "callee"])
    out = out.select("path", "start", "end", F.lit("chain").alias("kind"), F.concat("caller", F.lit(" > calls > "), "callee").alias("breadcrumb"), F.concat("caller_text", F.lit(DIVIDER), "callee_text").alias("text"))
    return out.orderBy("path", "breadcrumb", "start").limit(cap)

"""Weighted reciprocal-rank fusion of lexical, vector and structural lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import LEXICAL_WEIGHT, rrf, source_label

FUSED = "query_id string, path string, start long, end long, breadcrumb string, lexical_rank long, vector_rank long, ast_rank long, lexical_sum double"


def depth(limit: int) -> int:
    """Rows fetched from each side."""
    return max(10 * limit, 50)


def merged_lexical(lexical: DataFrame) -> DataFrame:
    """Rows of equal chunk key become one: their terms add up, the first rank stays."""
    return lexical.groupBy("query_id", "path", "start", "end", "breadcrumb").agg(F.sum(rrf("rank", LEXICAL_WEIGHT)).alias("lexical_sum"), F.min("rank").alias("lexical_rank"))


def _credited(rows: pd.DataFrame) -> pd.DataFrame:
    """One query: vector hits in rank order, then structural ones, each credited to the free slot of its file that it overlaps most (the last of equals), or a row of its own."""
    out: list[dict] = []
    of: dict[str, list[dict]] = {}
    lexical: dict[str, int] = {}
    hits = rows.sort_values(["kind", "rank"]).to_dict("records")
    for h in hits:
        name = ("lexical_rank", "vector_rank", "ast_rank")[h["kind"]]
        slots = of.setdefault(h["path"], [])
        best, slot = 0, None
        for s in slots[: lexical.get(h["path"], 0)] if h["kind"] == 1 else slots if h["kind"] == 2 else ():
            o = min(s["end"], h["end"]) + 1 - max(s["start"], h["start"])
            if s[name] is None and o > 0 and o >= best:
                best, slot = o, s
        if slot is None:
            slot = {"query_id": h["query_id"], "path": h["path"], "start": h["start"], "end": h["end"], "breadcrumb": h["breadcrumb"], "lexical_rank": None, "vector_rank": None, "ast_rank": None, "lexical_sum": h["lexical_sum"]}
            slots.append(slot)
            out.append(slot)
            if h["kind"] == 0:
                lexical[h["path"]] = len(slots)
        slot[name] = h["rank"]
    return pd.DataFrame(out).astype({c: "Int64" for c in ("lexical_rank", "vector_rank", "ast_rank")})


def fused(lexical: DataFrame, vector: DataFrame, structural: DataFrame | None = None) -> DataFrame:
    """All rows with their ranks, score and source. Lists have query_id, path, start, end, breadcrumb, rank.

    Crediting depends on order, so it runs by query; lists are cut to `depth` before they come
    here, so a group is small.
    """
    side = lambda df, kind: df.select(F.col("query_id").cast("string").alias("query_id"), "path", "start", "end", "breadcrumb", F.col("rank").cast("long").alias("rank"), F.lit(0.0).alias("lexical_sum"), F.lit(kind).alias("kind"))
    lex = merged_lexical(lexical).select(F.col("query_id").cast("string").alias("query_id"), "path", "start", "end", "breadcrumb", F.col("lexical_rank").cast("long").alias("rank"), "lexical_sum", F.lit(0).alias("kind"))
    rows = lex.unionByName(side(vector, 1))
    if structural is not None:
        rows = rows.unionByName(side(structural, 2))
    out = rows.groupBy("query_id").applyInPandas(_credited, FUSED)
    score = F.col("lexical_sum") + rrf("vector_rank") + rrf("ast_rank")
    return out.withColumn("score", score).withColumn("source", source_label("lexical_rank", "vector_rank", "ast_rank")).drop("lexical_sum")


def ordered(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows of all queries by score, then ranks with missing ones last."""
    from pyspark.sql import Window as W

    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("ast_rank"), "path", "start", "end")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)


def hybrid(lexical: DataFrame, vector: DataFrame, limit: int = 10, structural: DataFrame | None = None) -> DataFrame:
    """Fetch depth on each side, fuse, order, limit."""
    n = depth(limit)
    return ordered(fused(lexical.where(F.col("rank") <= n), vector.where(F.col("rank") <= n), structural), limit)


def collected(lexical: DataFrame, vector: DataFrame | None, limit: int = 10, structural: DataFrame | None = None) -> DataFrame:
    """Hybrid rows where there are vectors, else the lexical list alone in the same shape."""
    if vector is not None:
        return hybrid(lexical, vector, limit, structural)
    return hybrid(lexical, lexical.limit(0), limit, structural)


def with_fallback(found: DataFrame, queries: DataFrame, live: DataFrame) -> DataFrame:
    """The rows of each query, and rows of a live search(query_id, path, start, end, breadcrumb, rank) for queries that have none."""
    none = queries.select(F.col("query_id").cast("string").alias("query_id")).join(found.select("query_id").distinct(), "query_id", "left_anti")
    more = live.withColumn("query_id", F.col("query_id").cast("string")).join(none, "query_id")
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema if f.name not in live.columns}
    empty["score"], empty["source"] = F.lit(0.0).alias("score"), F.lit("rg").alias("source")
    return found.unionByName(more.select(*[F.col(c).cast(found.schema[c].dataType).alias(c) if c in live.columns and c not in ("score", "source") else empty[c] for c in found.columns]))


def kept_hits(hits: DataFrame, langs: list[str] = (), globs: list[str] = ()) -> DataFrame:
    """Hits whose paths pass the filters. They are applied to the list that a search gave, so it may come out shorter."""
    from siftwell.functions.text import in_languages, keeps_globs

    out = hits.where(in_languages("path", list(langs))) if langs else hits
    return out.where(keeps_globs("path", list(globs))) if globs else out

"""What results are written as: lines of text, JSON envelopes, dumps, markers and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.sources.workspace import read_table

STALE = "stale boolean, at timestamp"


def first_line(text: Column | str) -> Column:
    """The first line that is not blank, trimmed."""
    return F.coalesce(F.trim(F.get(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""), F.lit(0))), F.lit(""))


def rendered(path, start, end, breadcrumb, score, source) -> Column:
    """path:start-end [crumb] (score) source=…, a line a hit."""
    crumb = F.regexp_replace(breadcrumb, r"\s+", " ")
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.when(crumb != "", F.concat(F.lit(" ["), crumb, F.lit("]"))).otherwise(""), F.format_string(" (%.3f) source=%s", score.cast("double"), source))


def as_text(hits: DataFrame) -> DataFrame:
    """query_id, text: the rendered hits of each query in order, `0 hits` where there are none (queries in `hits` with a null rank)."""
    line = F.when(F.col("rank").isNotNull(), F.struct("rank", rendered(F.col("path"), F.col("start"), F.col("end"), F.col("breadcrumb"), F.col("score"), F.col("source")).alias("line")))
    rows = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(line)).alias("rows"))
    return rows.select("query_id", F.when(F.size("rows") == 0, "0 hits").otherwise(F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("text"))


def as_envelope(hits: DataFrame, notes: list[str] = ()) -> DataFrame:
    """query_id, json: {"notes": [...], "hits": [...]} of each query, hits in order."""
    names = [c for c in hits.columns if c not in ("query_id",)]
    hit = F.when(F.col("rank").isNotNull(), F.struct("rank", *[c for c in names if c != "rank"]))
    rows = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    return rows.select("query_id", F.to_json(F.struct(F.array(*[F.lit(n) for n in notes]).cast("array<string>").alias("notes"), "hits")).alias("json"))


def dump_chunks(chunks: DataFrame, place: str) -> None:
    """One JSON object a chunk, a line each."""
    chunks.write.mode("overwrite").json(place)


def notes(indexed: bool, stale: bool, vectors_stale: bool) -> list[str]:
    """What a caller should know about the stores a search has read."""
    out = []
    if not indexed:
        out.append("workspace is not indexed: results come from a live search")
    if indexed and stale:
        out.append("index is out of date: sync it")
    if vectors_stale:
        out.append("vectors are out of date: embed again")
    return out


def mark_stale(spark: SparkSession, place: str) -> None:
    """The index has been synced without its vectors."""
    spark.range(1).select(F.lit(True).alias("stale"), F.current_timestamp().alias("at")).write.mode("overwrite").parquet(place)


def clear_stale(spark: SparkSession, place: str) -> None:
    spark.createDataFrame([], STALE).write.mode("overwrite").parquet(place)


def is_stale(spark: SparkSession, place: str) -> bool:
    return not read_table(spark, place, STALE).isEmpty()


def pairs(triples: DataFrame, chunks: DataFrame, place: str | None = None) -> DataFrame:
    """Mined (query, path, start, end, label) rows with the chunks' texts; written as JSON lines where a place is given."""
    out = triples.join(chunks.select("path", "start", "end", "text"), ["path", "start", "end"], "left")
    if place:
        out.write.mode("overwrite").json(place)
    return out


def asked(query: Column | str, anchors: list[str] = (), prefix: str = "") -> Column:
    """A query as it is searched: the model's prefix, the text, and exact terms after it."""
    return F.concat(F.lit(prefix), F.concat_ws(" ", query, *[F.lit(a) for a in anchors]))

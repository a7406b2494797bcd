"""Retrieval quality over labelled query sets."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siftwell.operators.lexical import query_kind

DEPTHS = (1, 3, 5, 20)
#: Queries of a pool that one pass scores, and items that a task scores with them at once: a table of 8 bytes for each pair.
BLOCK, POOL_ROWS = 4096, 1024


def outcomes(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """id, kind, expected, rank, hits of cases(id, kind, query, expected) against hits(id, path, rank): the first path that holds the expected text."""
    met = cases.join(hits, "id", "left")
    right = F.col("path").contains(F.col("expected"))
    return met.groupBy("id", "kind", "expected").agg(F.min(F.when(right, F.col("rank"))).alias("rank"), F.count("path").alias("hits"))


def recall(k: int) -> Column:
    return F.round(F.avg(F.when(F.col("expected").isNotNull(), F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)))), 6)


def report(o: DataFrame) -> DataFrame:
    """One row of metrics over outcomes."""
    answerable = F.col("expected").isNotNull()
    return o.agg(
        F.count(F.lit(1)).alias("cases"),
        *[recall(k).alias(f"recall_{k}") for k in DEPTHS],
        F.round(F.avg(F.when(answerable, F.coalesce(1 / F.col("rank"), F.lit(0.0)))), 6).alias("mrr"),
        F.count_if(~answerable & (F.col("hits") == 0)).alias("empty_correct"),
        F.count_if(answerable & (F.col("hits") == 0)).alias("false_abstentions"),
    )


def by_kind(o: DataFrame) -> DataFrame:
    return o.where("expected is not null").groupBy("kind").agg(recall(3).alias("recall_3"), F.count(F.lit(1)).alias("cases"))


def latency(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Nearest-rank p50 and p95."""
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"))


def evaluate_with(cases: DataFrame, search: Callable[[DataFrame, int], DataFrame], limit: int = 20) -> DataFrame:
    """Outcomes of any search: a function of queries(query_id, query) and a limit that gives query_id, path, rank."""
    hits = search(cases.select(F.col("id").alias("query_id"), "query"), limit)
    return outcomes(cases, hits.select(F.col("query_id").alias("id"), "path", "rank"))


def split(cases: DataFrame, by: str = "id") -> DataFrame:
    """Cases with `part`: every other one in order is for development, the rest are held out."""
    place = F.row_number().over(W.orderBy(by))  # a label set, not a corpus
    return cases.withColumn("part", F.when(place % 2 == 1, "dev").otherwise("held"))


def best_of(runs: DataFrame) -> DataFrame:
    """level, queries, mean_ms, hit_rate of runs(label, level, ms, found): the best run of each label counts."""
    best = runs.groupBy("label", "level").agg(F.min("ms").alias("ms"), F.max("found").alias("found"))
    return best.groupBy("level").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.round(F.avg(F.col("found").cast("double")), 6).alias("hit_rate"))


def pool_recall(queries: DataFrame, pool: DataFrame, depths=(1, 3, 10)) -> DataFrame:
    """Recall of queries(query_id, q, file) in a pool(item, file, embedding): a hit is any item of the query's own file.

    Ranks are counts of better items, so no list is sorted or kept. All pairs are scored, BLOCK queries
    by POOL_ROWS items at a time; a task gives a number for each query, and nothing else is shuffled.
    """
    spark = pool.sparkSession
    name, kind = query_kind(queries)
    read = pool.select("file", F.transform("embedding", lambda x: x.cast("double")).alias("e"))

    def pairs(batches: Iterator[pa.RecordBatch], q: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """Rounded scores of items by queries, and the items' files. Items without a whole vector score nothing with any query."""
        for batch in batches:
            e = batch.column("e")
            whole = pc.equal(pc.list_value_length(e), q.shape[1])
            batch = batch.filter(pc.fill_null(whole, False))
            for a in range(0, batch.num_rows, POOL_ROWS):
                part = batch.slice(a, POOL_ROWS)
                x = part.column("e").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                s = np.round(x @ q.T, 6)
                yield np.where(np.isnan(s), -np.inf, s), part.column("file")  # a missing number gives no score

    def block(ids: list, files: list, q: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, pa.array(files, to_arrow_type(queries.schema["file"].dataType)), q))

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, files, q = shared.value
            best = np.full(len(q), -np.inf)
            for s, file in pairs(batches, q):
                best = np.maximum(best, np.where(_same(file, files), s, -np.inf).max(axis=0, initial=-np.inf))
            there = np.flatnonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(best[there])], ["at", "best"])

        found = {r["at"]: r["best"] for r in read.mapInArrow(own, "at long, best double").groupBy("at").agg(F.max("best").alias("best")).collect()}
        bests = spark.sparkContext.broadcast(np.array([found.get(i, np.nan) for i in range(len(ids))]))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (ids, files, q), best = shared.value, bests.value
            better = np.zeros(len(q), np.int64)
            for s, file in pairs(batches, q):
                better += ((s > best) & ~_same(file, files) & np.asarray(pc.is_valid(file))[:, None]).sum(axis=0)
            there = np.flatnonzero(~np.isnan(best))
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind).take(pa.array(there)), pa.array(better[there])], ["query_id", "better"])

        return read.mapInArrow(count, f"query_id {name}, better long").groupBy("query_id").agg(F.sum("better").alias("better"))

    better, rows = None, []
    asked = queries.where("q is not null and file is not null").select("query_id", "file", F.transform("q", lambda x: x.cast("double")).alias("q"))
    for width in sorted(r.n for r in asked.select(F.size("q").alias("n")).distinct().collect()):
        for r in itertools.chain(asked.where(F.size("q") == width).toLocalIterator(), [None]):
            if r is not None:
                rows.append(r)
            if rows and (r is None or len(rows) == BLOCK):
                made = block([x["query_id"] for x in rows], [x["file"] for x in rows], np.array([x["q"] for x in rows], np.float64))
                better, rows = made if better is None else better.unionByName(made), []
    if better is None:
        better = spark.createDataFrame([], f"query_id {name}, better long")
    rows = queries.select("query_id").join(better, "query_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(F.coalesce(F.col("better") < k, F.lit(False)).cast("double")), 6).alias(f"recall_{k}") for k in depths])


def _same(file: pa.Array, files: pa.Array) -> np.ndarray:
    """Items by queries: whether they are of one file. A missing file is no one's."""
    at = pc.index_in(file, value_set=(known := files.unique())).fill_null(-1)
    return np.asarray(at)[:, None] == np.asarray(pc.index_in(files, value_set=known))[None, :]


def next_read(log: DataFrame, reads: DataFrame, within: str) -> DataFrame:
    """The rows of log(root, ts, query) with the first read(root, ts, path) of the same root after them, if `within` that time."""
    both = log.select("root", "ts", "query", F.lit(None).cast("string").alias("path"), F.lit(None).cast("timestamp").alias("read_ts")).unionByName(
        reads.select("root", "ts", F.lit(None).cast("string").alias("query"), "path", F.col("ts").alias("read_ts"))
    )
    later = W.partitionBy("root").orderBy(F.col("ts"), F.col("read_ts").asc_nulls_first(), F.col("path")).rowsBetween(1, W.unboundedFollowing)
    found = both.withColumn("next", F.first(F.when(F.col("path").isNotNull(), F.struct("read_ts", "path")), ignorenulls=True).over(later)).where("query is not null")
    near = F.col("next.read_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}")
    return found.select("root", "ts", "query", F.when(near, F.col("next.path")).alias("path"), F.when(near, F.col("next.read_ts")).alias("read_ts"))

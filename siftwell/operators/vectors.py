"""Vector stores: exact cosine search for query batches and incremental embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions.text import cut_bytes, dot, normalized

EMBED_BYTES, EMBED_BATCH = 1500, 16
BLOCK = 256
ID = ["rel", "start", "end", "breadcrumb"]


def top(store: DataFrame, query: list[float], limit: int, keys: list[str]) -> DataFrame:
    """The rows nearest to one vector: a projection and a top-k without a shuffle of the store."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = store.select(*keys, F.round(dot("embedding", q), 6).alias("score"))
    return scored.orderBy(F.desc("score"), *keys).limit(limit)


def top_batch(store: DataFrame, queries: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """The rows nearest to each of a batch of queries(query_id, q).

    Blocks of BLOCK queries (a bounded 8 bytes a number) are scored against each batch of rows at
    once, and only a task's own best rows of each query are shuffled. All ties at the last place are
    kept until the end, where the key decides.
    """
    spark = store.sparkSession
    ids, vectors, out = [], [], None
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in store.select(*keys).schema)
    kind = queries.schema["query_id"].dataType.simpleString()

    def block(ids: list, vectors: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, np.array(vectors, np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            if not ids:
                return
            best: list[pa.Table] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.asarray(batch.column("embedding").flatten(), np.float64).reshape(batch.num_rows, -1)
                s = np.round(x @ q.T, 6)
                least = -np.partition(-s, min(limit, len(s)) - 1, axis=0)[min(limit, len(s)) - 1]
                row, of = np.nonzero(s >= least[None, :])
                part = [pa.array(ids).take(pa.array(of)), *(batch.column(k).take(pa.array(row)) for k in keys), pa.array(s[row, of])]
                best.append(pa.Table.from_arrays(part, ["query_id", *keys, "score"]))
            if best:
                yield from pa.concat_tables(best).to_batches()

        width = len(vectors[0]) if vectors else 0
        return store.where(F.size("embedding") == width).select(*keys, "embedding").mapInArrow(run, f"query_id {kind}, {names}, score double")

    for r in queries.select("query_id", "q").toLocalIterator():
        ids.append(r["query_id"])
        vectors.append(r["q"])
        if len(ids) == BLOCK:
            made = block(ids, vectors)
            out = made if out is None else out.unionByName(made)
            ids, vectors = [], []
    if ids or out is None:
        made = block(ids, vectors)
        out = made if out is None else out.unionByName(made)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), *keys)
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)


def needs_embedding(current: DataFrame, store: DataFrame) -> DataFrame:
    """Current chunks without a stored vector of the same text."""
    have = store.select(*ID, F.sha2("text", 256).alias("h"))
    return current.withColumn("h", F.sha2("text", 256)).join(have, [*ID, "h"], "left_anti").drop("h")


def retained(store: DataFrame, current: DataFrame) -> DataFrame:
    return store.join(current.select(*ID).distinct(), ID, "left_semi")


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Vectors of length one for chunk texts, in batches of EMBED_BATCH texts cut to EMBED_BYTES."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors: list[list[float]] = []
            for a in range(0, len(pdf), EMBED_BATCH):
                vectors += embed(pdf["_cut"].iloc[a : a + EMBED_BATCH].tolist())
            yield pdf.drop(columns="_cut").assign(embedding=vectors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema) + ", embedding array<double>"
    out = chunks.withColumn("_cut", cut_bytes("text", EMBED_BYTES)).mapInPandas(run, schema)
    return out.withColumn("embedding", normalized("embedding"))


def sync(current: DataFrame, store: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """The next store: kept rows of unchanged text and new vectors for the rest."""
    new = embedded(needs_embedding(current, store), embed)
    kept = retained(store, current).join(new.select(*ID), ID, "left_anti")
    return kept.unionByName(new)


def same_model(store_model: str, store_dims: int, model: str, dims: int) -> bool:
    """Whether a store can be searched with a model's vectors."""
    return store_model == model and store_dims == dims


def usable_store(store: DataFrame, store_model: str, store_dims: int, model: str, dims: int) -> DataFrame:
    """The store to go on from: as it is for the same model, empty for another one, so that all is embedded anew."""
    return store if same_model(store_model, store_dims, model, dims) else store.limit(0)


def counters(current: DataFrame, store: DataFrame) -> DataFrame:
    """One row: chunks, how many have their vector, are to be embedded, and are to be dropped from the store."""
    todo = needs_embedding(current, store).agg(F.count(F.lit(1)).alias("to_embed"))
    gone = store.join(current.select(*ID).distinct(), ID, "left_anti").agg(F.count(F.lit(1)).alias("to_drop"))
    return current.agg(F.count(F.lit(1)).alias("chunks")).crossJoin(todo).crossJoin(gone).withColumn("kept", F.col("chunks") - F.col("to_embed"))  # a row each


def in_order(store: DataFrame) -> DataFrame:
    """The order in which a store is kept."""
    return store.orderBy(*ID)

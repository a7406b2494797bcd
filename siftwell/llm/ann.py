"""Approximate nearest neighbours by largest inner product, with balanced posting lists.

There are as many lists as the square root of the rows, so a query is sent to a number of lists that
grows more slowly than the table, and lists are longer instead.
Centroids are fitted on a bounded sample: halving along the main direction gives lists of equal
size, a few rounds of averaging settle them. All rows are indexed: a vector goes to the lists of
its nearest centroids, found by a beam search over an in-memory graph of centroids, and boundary
vectors (other centroids not much farther than the nearest) go to several. A query searches all
lists whose centroids are within a distance ratio of its nearest one, however many. Lists that come out too long
are cut into parts, which are searched apart, so no task holds an unbounded list.

Inner products become distances by one more coordinate that gives all vectors the same length.
Rows without an id, and vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
length isn't the most common one. Ties go to the smaller id; repeated vectors are rows of their
own. An empty table gives no rows. Only the id and the vector are read, so other columns can't clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.llm.common import staged, unit_hash

#: Rows that the centroids are fitted on at most, and centroids at most (what is broadcast).
SAMPLE, MOST_LISTS = 131_072, 16_384
#: Rows of a list at least, about.
LIST_ROWS = 100
REPLICAS, REPLICA_RATIO = 8, 1.1
PROBE_RATIO = 1.25
#: Lists of queries that are sent on at once.
ASKED_ROWS = 50_000
DEGREE, BEAM = 24, 64
#: Rows of a list part at most.
PART_ROWS = 4096
NEAREST = 20


def usable(v: Column) -> Column:
    """A vector without null or non-finite components that isn't zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


class Centroids:
    """Centroids with a neighbour graph; `lift` is the squared length that all vectors are raised to."""

    def __init__(self, sample: np.ndarray, lists: int, lift: float):
        self.lift = lift
        x = self.lifted(sample)
        groups = {0: np.arange(len(x))}
        heap = [(-len(x), 0)]
        rng, label = np.random.default_rng(11), 1
        while len(groups) < min(lists, len(x)):
            idx = groups.pop(heapq.heappop(heap)[1])
            y = x[idx] - x[idx].mean(axis=0)
            v = rng.standard_normal(y.shape[1])
            for _ in range(6):
                v = y.T @ (y @ v)
                v /= np.linalg.norm(v) + 1e-12
            order = np.argsort(y @ v, kind="stable")
            for half in (idx[order[: len(order) // 2]], idx[order[len(order) // 2 :]]):
                groups[label] = half
                heapq.heappush(heap, (-len(half), label))
                label += 1
        c = np.stack([x[i].mean(axis=0) for i in groups.values()])
        for _ in range(3):
            own = np.concatenate([np.argmax(x[a : a + 4096] @ c.T - 0.5 * (c**2).sum(axis=1), axis=1) for a in range(0, len(x), 4096)])
            count, total = np.bincount(own, minlength=len(c)), np.zeros_like(c)
            np.add.at(total, own, x)
            c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        self.c = c.astype(np.float32)
        self.half = (0.5 * (self.c**2).sum(axis=1)).astype(np.float32)
        self._link()

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.lift - (x.astype(np.float64) ** 2).sum(axis=1)))
        return np.concatenate([x, rest[:, None].astype(x.dtype)], axis=1)

    def _link(self) -> None:
        n = len(self.c)
        k = min(DEGREE, n - 1)
        near = np.zeros((n, k), np.int64)
        for a in range(0, n, 1024):
            d = self.half[None, :] - self.c[a : a + 1024] @ self.c.T
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            near[a : a + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else near[a : a + 1024]
        far = np.random.default_rng(12).integers(0, n, (n, 8))  # long links join parts that are far apart
        self.links = np.concatenate([near, far], axis=1)
        self.entry = np.unique(np.linspace(0, n - 1, min(n, BEAM)).astype(np.int64))

    def search(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of and squared distances to the `most` nearest centroids found for lifted vectors, nearest first."""
        n, width = len(x), min(len(self.c), max(BEAM, most))
        x = x.astype(np.float32)
        own = 0.5 * (x**2).sum(axis=1)
        ids = np.tile(self.entry, (n, 1))
        dist = self.half[ids] - x @ self.c[self.entry].T
        done = np.zeros(ids.shape, bool)
        step = 4
        for _ in range(4 * width):
            todo = np.where(done, np.inf, dist)
            pick = np.argpartition(todo, min(step, todo.shape[1] - 1), axis=1)[:, :step]
            live = np.isfinite(np.take_along_axis(todo, pick, axis=1))
            if not live.any():
                break
            np.put_along_axis(done, pick, True, axis=1)
            new = self.links[np.take_along_axis(ids, pick, axis=1)].reshape(n, -1)
            d = self.half[new] - np.einsum("nkd,nd->nk", self.c[new], x)
            d[np.repeat(~live, self.links.shape[1], axis=1)] = np.inf
            ids, dist = np.concatenate([ids, new], axis=1), np.concatenate([dist, d], axis=1)
            done = np.concatenate([done, np.zeros(new.shape, bool)], axis=1)
            order = np.lexsort((~done, ids), axis=1)  # of repeated ids one stays, done if any was
            ids, dist, done = (np.take_along_axis(a, order, axis=1) for a in (ids, dist, done))
            again = np.zeros(ids.shape, bool)
            again[:, 1:] = ids[:, 1:] == ids[:, :-1]
            dist = np.where(again, np.inf, dist)
            keep = np.argsort(dist, axis=1, kind="stable")[:, :width]
            ids, dist, done = (np.take_along_axis(a, keep, axis=1) for a in (ids, dist, done))
            done |= ~np.isfinite(dist)
        order = np.argsort(dist, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, order, axis=1), 2 * np.maximum(0.0, np.take_along_axis(dist, order, axis=1) + own[:, None])

    def within(self, x: np.ndarray, ratio: float) -> list[np.ndarray]:
        """For each lifted vector all centroids at most `ratio` times as far as its nearest one, nearest first."""
        d = 2 * np.maximum(0.0, self.half - x @ self.c.T + 0.5 * (x**2).sum(axis=1, keepdims=True))
        order = np.argsort(d, axis=1, kind="stable")
        near = (d <= ratio**2 * np.maximum(d.min(axis=1, keepdims=True), 1e-12)).sum(axis=1)
        return [o[:n] for o, n in zip(order, near)]


def matrix(col: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows."""
    flat = np.asarray(col.flatten())
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def fitted(vectors: DataFrame, dims: int, total: int, lift: float) -> Centroids:
    """Centroids from at most SAMPLE rows that a hash of the id picks."""
    lists = int(np.clip(min(total // LIST_ROWS, total**0.5), 1, MOST_LISTS))
    want = min(SAMPLE, 64 * lists + 1024)
    rows = vectors.where(unit_hash(F.col("id"), 3) < 0.95 * want / total) if total > want else vectors
    t = rows.orderBy("id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    sample = matrix(t).astype(np.float64)
    if not len(sample):
        sample = np.zeros((1, dims))
    return Centroids(sample, lists, lift)


def indexed(vectors: DataFrame, centroids) -> DataFrame:
    """id, v, query, replica lists and, for queries, the lists to search in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = matrix(part.column("v")).astype(np.float64)
                lists, dist = c.search(c.lifted(x), REPLICAS)
                keep = (dist <= REPLICA_RATIO**2 * dist[:, :1] + 1e-12) & np.isfinite(dist)
                keep[:, 0] = True
                query = part.column("query").to_numpy(zero_copy_only=False)
                probes: list[list[int] | None] = [None] * len(x)
                if query.any():
                    # a query has no further coordinate: any length serves, as only the order of inner products counts
                    norm = np.sqrt((x[query] ** 2).sum(axis=1, keepdims=True))
                    q = np.concatenate([x[query] * np.sqrt(c.lift) / norm, np.zeros((int(query.sum()), 1))], axis=1)
                    at = np.flatnonzero(query).tolist()
                    for b in range(0, len(at), 128):
                        for k, lists_of in zip(at[b : b + 128], c.within(q[b : b + 128], PROBE_RATIO)):
                            probes[k] = lists_of.tolist()
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), part.column("query"), pa.array([l[k].tolist() for l, k in zip(lists, keep)], pa.list_(pa.int32())), pa.array(probes, pa.list_(pa.int32()))], ["id", "v", "query", "lists", "probes"])

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.mapInArrow(run, f"id long, v {kind}, query boolean, lists array<int>, probes array<int>")


def nearest(df: DataFrame, id_column: str, vector_column: str, is_query: Column, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every query row, itself left out."""
    spark = df.sparkSession
    vectors = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = vectors.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("lift")).orderBy(F.desc("n"), "dims").limit(1).collect()
    dims, total, lift = sizes[0] if sizes else (1, 0, 1.0)
    vectors = vectors.where(F.size("v") == dims)
    made = fitted(vectors, dims, total, lift * (1 + 1e-9))
    rows = staged(indexed(vectors, spark.sparkContext.broadcast(made)), "postings")
    posting = rows.select("id", "v", F.posexplode("lists").alias("replica", "list"))
    n_lists = len(made.c)
    counts, first = np.zeros(n_lists, np.int64), np.zeros(n_lists, np.int64)
    for l, n, own in posting.groupBy("list").agg(F.count(F.lit(1)), F.count_if(F.col("replica") == 0)).collect():
        counts[l], first[l] = n, own
    parts = spark.sparkContext.broadcast((np.maximum(1, -(-counts // PART_ROWS)), first))
    part_rows = spark.createDataFrame([(l, int(p)) for l, p in enumerate(parts.value[0].tolist())], "list int, parts int")
    posting = posting.join(F.broadcast(part_rows), "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "v")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query's lists: those within the ratio, and more while they hold too few rows; every part of each."""
        n_parts, own = parts.value
        for batch in batches:
            at, lists, part = [], [], []

            def out() -> pa.RecordBatch:
                index = pa.array(at, pa.int64())
                made = pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(part, pa.int32()), pa.array(np.ones(len(at), np.int32)), batch.column("id").take(index), batch.column("v").take(index)], ["list", "part", "kind", "id", "v"])
                for x in (at, lists, part):
                    x.clear()
                return made

            for i, probes in enumerate(batch.column("probes").to_pylist()):
                have = 0
                order = probes + sorted(set(range(n_lists)) - set(probes)) if own[probes].sum() <= k else probes
                for j, l in enumerate(order):
                    if j >= len(probes) and have > k:
                        break
                    have += int(own[l])
                    for p in range(int(n_parts[l])):
                        at.append(i)
                        lists.append(l)
                        part.append(p)
                if len(at) > ASKED_ROWS:
                    yield out()
            yield out()

    kind = vectors.schema["v"].dataType.simpleString()
    asked = rows.where("query").select("id", "v", "probes").mapInArrow(chosen, f"list int, part int, kind int, id long, v {kind}")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by list, part and kind: a part's vectors are held, its queries scored against them."""
        here, ids, vs = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            l, p, kd = (batch.column(c).to_numpy() for c in ("list", "part", "kind"))
            i, x = batch.column("id").to_numpy(), matrix(batch.column("v")).astype(np.float64)
            key = (l.astype(np.int64) << 32) | (p.astype(np.int64) << 1) | kd
            edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if key[a] >> 1 != here:
                    here, ids, vs = key[a] >> 1, [], []
                if not kd[a]:
                    ids.append(i[a:b])
                    vs.append(x[a:b])
                    continue
                if not ids:
                    continue
                ids, vs = [np.concatenate(ids)], [np.concatenate(vs)]
                for c in range(a, b, 512):
                    q = slice(c, min(b, c + 512))
                    s = x[q] @ vs[0].T
                    s[i[q][:, None] == ids[0][None, :]] = -np.inf
                    top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, : min(k, s.shape[1])]
                    least = np.take_along_axis(s, top, axis=1).min(axis=1)
                    r, j = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                    v = s[r, j]
                    order = np.lexsort((ids[0][j], -v, r))
                    r, j, v = r[order], j[order], v[order]
                    rank = np.arange(len(r)) - np.searchsorted(r, r)
                    ok = rank < k
                    yield pa.RecordBatch.from_arrays([pa.array(i[q][r[ok]]), pa.array(ids[0][j[ok]]), pa.array(v[ok])], ["query_id", "vec_id", "score"])

    met = posting.unionByName(asked).repartition("list", "part").sortWithinPartitions("list", "part", "kind", "id")
    found = met.mapInArrow(scored, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

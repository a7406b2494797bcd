"""A stored lexical index: segments that searches read, and that a sync adds to.

Every sync writes one generation: segments of the chunks of new and changed files, and a mark for each
path it replaces or removes. Chunks of an older generation than their path's mark are dead. Nothing
that is stored is written again until `compact`.

A segment holds some thousands of chunks that a task read one after another: a row for the chunks'
keys, one for their lengths in each field, and one for each term, which names chunks by their place in
the segment. All that scores a chunk is in its segment, so segments are written without a shuffle and
scored one by one. A segment's rows are sorted by term, so a search for few terms reads few pages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import spaced
from siftwell.operators import grammar
from siftwell.operators.lexical import FIELDS, KEY, STATS, Asked, Best, blocks, counts, query_kind, ranked, split_terms, weighed
from siftwell.sources.workspace import read_table

#: A row of keys has no field, one of lengths (in tfs) has no term. Places are `ords`; `positions` of a term's chunks stand one after another, as many as `tfs` has.
SEGMENTS = "segment long, generation long, field string, term string, ords array<int>, tfs array<int>, positions array<int>, path array<string>, start array<long>, `end` array<long>, breadcrumb array<string>"
NAMES = ["segment", "generation", "field", "term", "ords", "tfs", "positions", *KEY]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.string()), *[pa.list_(pa.int64())] * 2, pa.list_(pa.string())]
MARKS = "path string, generation long"
#: Terms of a batch of queries that are pushed into the scan as a list; more are joined.
LISTED = 1000
#: A segment ends with so many chunks or terms; these many are added at once.
CHUNKS, TERMS, STEP = 8192, 2_000_000, 256


def _rows(n: int, **columns) -> pa.RecordBatch:
    """A batch of n rows of SEGMENTS; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in zip(NAMES, TYPES)], NAMES)


def _lists(values, offsets) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values) if isinstance(values, np.ndarray) else values)


def _segment(keys: pa.Table, texts: list[pa.Array], fields: list[str], generation: int) -> Iterator[pa.RecordBatch]:
    """The rows of one segment, of chunk keys and each field's texts as `spaced` gives them."""
    n, one = keys.num_rows, lambda k, m: pa.array(np.full(m, k, np.int64))
    name = uuid.uuid4().int >> 65
    yield _rows(1, segment=one(name, 1), generation=one(generation, 1), **{k: _lists(keys.column(k).combine_chunks(), [0, n]) for k in KEY})
    for f, text in zip(fields, texts):
        row, pos, flat, dl = split_terms(text)
        yield _rows(1, segment=one(name, 1), generation=one(generation, 1), field=pa.array([f]), tfs=_lists(dl.astype(np.int32), [0, n]))
        coded = flat.dictionary_encode()
        order = np.asarray(pc.sort_indices(coded.dictionary))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term = place[np.asarray(coded.indices)]
        by = np.argsort(term, kind="stable")
        term, row, pos = term[by], row[by], pos[by]
        first = np.flatnonzero(np.diff(term * n + row, prepend=-1))
        tf, words = np.diff(first, append=len(term)), coded.dictionary.take(pa.array(order))
        edge = np.arange(len(words) + 1)
        ords = _lists(row[first].astype(np.int32), np.searchsorted(term[first], edge))
        tfs = _lists(tf.astype(np.int32), np.searchsorted(term[first], edge))
        m = len(words)
        yield _rows(m, segment=one(name, m), generation=one(generation, m), field=pa.array([f] * m, pa.string()), term=words, ords=ords, tfs=tfs, positions=_lists(pos.astype(np.int32), np.searchsorted(term, edge)))


class Segment:
    """A segment as read for a search: its chunks' keys and lengths, which are alive, and the terms that were asked for."""

    def __init__(self, table: pa.Table):
        rows = table.combine_chunks()
        field, term = rows.column("field").to_pylist(), rows.column("term").to_pylist()
        self.rows, self.keys, self.dl, self.at = rows, None, {}, {}
        array = lambda name, i: rows.column(name).chunk(0)[i].values
        self.array = lambda name, i: np.asarray(array(name, i))
        dead = []
        for i, (f, w) in enumerate(zip(field, term)):
            if w is not None:
                self.at[f, w] = i
            elif f is not None:
                self.dl[f] = np.asarray(array("tfs", i), np.int64)
            elif rows.column("path").chunk(0)[i].is_valid:
                self.keys = pa.table({k: array(k, i) for k in KEY})
            else:
                dead.append(self.array("ords", i))
        self.alive = np.ones(self.keys.num_rows, bool)
        for d in dead:
            self.alive[d] = False

    def met(self, field: str, words: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Living chunks in which the words stand one after another, and how often."""
        at = [self.at.get((field, w)) for w in words]
        if None in at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(at) == 1:
            row, tf = self.array("ords", at[0]), self.array("tfs", at[0])
        else:
            far = 1 + int(self.dl[field].max())
            begins = None
            for k, i in enumerate(at):  # a phrase is there where each of its terms stands k places after the phrase's begin
                pos = self.array("positions", i).astype(np.int64) - k
                here = (np.repeat(self.array("ords", i).astype(np.int64), self.array("tfs", i)) * far + pos)[pos >= 0]
                begins = here if begins is None else np.intersect1d(begins, here, assume_unique=True)
            row, tf = np.unique(begins // far, return_counts=True)
        return row[self.alive[row]].astype(np.int64), tf[self.alive[row]]


class StoredIndex:
    def __init__(self, spark: SparkSession, place: str, fields=FIELDS):
        self.spark, self.place, self.fields = spark, place.rstrip("/"), fields

    def _table(self, name: str, schema: str) -> DataFrame:
        return read_table(self.spark, f"{self.place}/{name}", schema)

    def _segments(self) -> DataFrame:
        return self._table("segments", SEGMENTS)

    def generation(self) -> int:
        return self._table("marks", MARKS).agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]

    def add(self, chunks: DataFrame, removed: DataFrame | None = None) -> int:
        """One generation: chunks of new and changed files, and paths that are gone. The marks come last and make it count."""
        g, fields = self.generation() + 1, list(dict.fromkeys(self.fields))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows, terms = [], 0, 0

            def made() -> Iterator[pa.RecordBatch]:
                t = pa.Table.from_batches(held)
                yield from _segment(t, [t.column(f"_{i}").combine_chunks() for i in range(len(fields))], fields, g)

            for batch in batches:
                for a in range(0, batch.num_rows, STEP):
                    part = batch.slice(a, STEP)
                    held.append(part)
                    rows += part.num_rows
                    terms += sum(pc.sum(pc.count_substring(part.column(f"_{i}"), " ")).as_py() or 0 for i in range(len(fields)))
                    if rows >= CHUNKS or terms >= TERMS:
                        yield from made()
                        held, rows, terms = [], 0, 0
            if rows:
                yield from made()

        long = [F.col(k).cast("long").alias(k) if k in ("start", "end") else k for k in KEY]
        chunks.select(*long, *(spaced(f).alias(f"_{i}") for i, f in enumerate(fields))).mapInArrow(run, SEGMENTS).write.mode("append").parquet(f"{self.place}/segments")
        paths = chunks.select("path").distinct()
        paths = paths if removed is None else paths.unionByName(removed.select("path")).distinct()
        paths.select("path", F.lit(g).cast("long").alias("generation")).write.mode("append").parquet(f"{self.place}/marks")
        return g

    def _dead(self) -> DataFrame:
        """Rows of SEGMENTS without a field or a path, whose `ords` are a segment's dead chunks: those whose path is of another generation now, or has no mark."""
        keys = self._segments().where("field is null").select("segment", "generation", F.posexplode("path").alias("ord", "path"))
        newest = self._table("marks", MARKS).groupBy("path").agg(F.max("generation").alias("newest"))
        dead = keys.join(newest, "path", "left").where("newest is null or generation <> newest").groupBy("segment").agg(F.collect_list("ord").alias("ords"))
        kinds = {f.name: f.dataType for f in self._segments().schema}
        return dead.select(*(c if c in ("segment", "ords") else F.lit(None).cast(kinds[c]).alias(c) for c in NAMES))

    def _each(self, terms: DataFrame, make: Callable, schema: str) -> DataFrame:
        """What `make` gives of each segment with some of the index's terms."""
        rows = self._segments().where("term is null").unionByName(terms).unionByName(self._dead())
        return rows.groupBy("segment").applyInArrow(make, schema)

    def compact(self, place: str) -> StoredIndex:
        """The living chunks as the only generation of an index in another place."""

        def make(table: pa.Table) -> pa.Table:
            s = Segment(table)
            n = int(s.alive.sum())
            now = np.cumsum(s.alive) - 1
            out = []
            if n:
                name, one = table.column("segment")[0].as_py(), pa.array([1], pa.int64())
                head = {"segment": pa.array([name], pa.int64()), "generation": one}
                mask = pa.array(s.alive)
                out.append(_rows(1, **head, **{k: _lists(s.keys.column(k).combine_chunks().filter(mask), [0, n]) for k in KEY}))
                out += [_rows(1, **head, field=pa.array([f]), tfs=_lists(dl[s.alive].astype(np.int32), [0, n])) for f, dl in s.dl.items()]
                for (f, w), i in sorted(s.at.items()):
                    row, tf, pos = s.array("ords", i), s.array("tfs", i), s.array("positions", i)
                    kept = s.alive[row]
                    if kept.any():
                        pos = pos[np.repeat(kept, tf)]
                        m = int(kept.sum())
                        out.append(_rows(1, **head, field=pa.array([f]), term=pa.array([w]), ords=_lists(now[row[kept]].astype(np.int32), [0, m]), tfs=_lists(tf[kept], [0, m]), positions=_lists(pos, [0, len(pos)])))
            return pa.Table.from_batches(out, schema=pa.schema(list(zip(NAMES, TYPES))))

        self._each(self._segments().where("term is not null"), make, SEGMENTS).write.mode("overwrite").parquet(f"{place}/segments")
        out = StoredIndex(self.spark, place, self.fields)
        paths = out._segments().where("field is null").select(F.explode("path").alias("path")).distinct()
        paths.withColumn("generation", F.lit(1).cast("long")).write.mode("overwrite").parquet(f"{place}/marks")
        return out

    def search(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """The best chunks of each of queries(query_id, query), by BM25 summed over matching items and fields.

        A segment is scored where its rows meet: once for counts, once for scores. Its best rows of
        each query are all that is shuffled then.
        """
        name, kind = query_kind(queries)
        schema = f"query_id {name}, path string, start long, `end` long, breadcrumb string, score double"
        out = None
        for asked in blocks(grammar.parsed(queries, self.fields)):
            made = self._block(asked, limit, kind, schema)
            out = made if out is None else out.unionByName(made)
        return ranked(self.spark.createDataFrame([], schema) if out is None else out, limit)

    def _block(self, asked: Asked, limit: int, kind: pa.DataType, schema: str) -> DataFrame:
        pairs = [(f, w) for f, words in asked.words.items() for w in words]
        listed = sorted({w for _, w in pairs})
        stored = self._segments().where(F.col("field").isin(sorted(asked.words)))
        if len(listed) <= LISTED:
            stored = stored.where(F.col("term").isin(listed))
        else:
            stored = stored.join(F.broadcast(self.spark.createDataFrame([(w,) for w in listed], "term string")), "term", "left_semi").select(*NAMES)
        if all(len(words) == 1 for _, words in asked.items):
            stored = stored.withColumn("positions", F.lit(None).cast("array<int>"))

        def count(table: pa.Table) -> pa.Table:
            s = Segment(table)
            df = {x: int(s.alive[s.array("ords", i)].sum()) for x, i in s.at.items()}
            n = {f: int(s.alive.sum()) for f in s.dl}
            return pa.Table.from_batches([counts(n, {f: int(s.dl[f][s.alive].sum()) for f in n}, {x: k for x, k in df.items() if k})])

        shared = self.spark.sparkContext.broadcast(weighed(asked, self._each(stored, count, STATS)))

        def run(table: pa.Table) -> pa.Table:
            s, asked = Segment(table), shared.value
            best, every = Best(asked, limit), []
            for i, (f, words) in enumerate(asked.items):
                row, tf = s.met(f, words)
                if len(row):
                    every.append((row, np.full(len(row), i), tf, s.dl[f][row] / asked.avgdl[f]))
            if every:
                row, item, tf, norm = (np.concatenate(x) for x in zip(*every))
                by = np.argsort(row, kind="stable")
                best.show(s.keys, row[by], item[by], tf[by], norm[by])
            names = ["query_id", *KEY, "score"]
            kinds = pa.schema(list(zip(names, [kind, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64()])))
            return pa.Table.from_batches(best.found(kind), schema=kinds)

        return self._each(stored, run, schema)

"""What a search, an index or a recall shuffles, and its results, where rows outnumber what a task keeps."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import lexical

ASK = "query_id long, query string"
CHUNK = "path string, start long, `end` long, breadcrumb string, text string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def brute(rows, queries, limit):
    """BM25 by the book: {query: [(score, path, start)]}."""
    docs = [(p, s, t.lower().split()) for p, s, _, _, t in rows]
    avgdl, out = sum(len(t) for *_, t in docs) / len(docs), {}
    for q, text in queries:
        found = []
        for p, s, t in docs:
            here = [w for w in sorted(set(text.lower().split())) if w in t]
            idf = [math.log(1 + (len(docs) - d + 0.5) / (d + 0.5)) for d in (sum(w in x for *_, x in docs) for w in here)]
            if here:
                found.append((-round(sum(i * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avgdl)) for w, i in zip(here, idf)), 6), p, s))
        out[q] = [(-a, p, s) for a, p, s in sorted(found)[:limit]]
    return out


def corpus(n=600):
    words = np.random.default_rng(3).choice(["ash", "birch", "cedar", "elm", "fir", "oak"], (n, 5), p=[0.5, 0.2, 0.1, 0.1, 0.06, 0.04])
    return [(f"p{i % 97}", i, i, "", "ash ash oak" if i % 3 == 0 else " ".join(words[i])) for i in range(n)]  # a third are copies


def test_search_shuffles_only_the_best_of_each_task(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ROWS", 64)
    monkeypatch.setattr(lexical, "BLOCK", 2)
    rows, queries = corpus(), [(0, "oak"), (1, "ash birch"), (2, "none"), (3, "fir elm oak"), (4, "")]
    chunks = spark.createDataFrame(rows, CHUNK).repartition(3)
    got = lexical.search(chunks, spark.createDataFrame(queries, ASK), 7, fields=("text",))
    assert "Join" not in plan(got) and "HashAggregate" not in plan(got)
    made: dict = {}
    for r in got.orderBy("query_id", "rank").collect():
        made.setdefault(r.query_id, []).append((r.score, r.path, r.start))
    assert made == {q: hits for q, hits in brute(rows, queries, 7).items() if hits}


def test_best_stays_bounded_in_copies(monkeypatch):
    import pyarrow as pa

    n = 200_000
    asked = lexical.Asked([(5, [("text", ["oak"], False)])])
    asked.weigh({"text": n}, {"text": n}, {("text", "oak"): n})
    best = lexical.Best(asked, 4)
    keys = pa.table({"path": [f"p{i:06d}" for i in reversed(range(n))], "start": [1] * n, "end": [1] * n, "breadcrumb": [""] * n})
    best.show(keys, np.arange(n), np.zeros(n, int), np.ones(n), np.ones(n))
    assert best.rows < 60_000
    assert [b.column("path").to_pylist() for b in best.found(pa.int64())] == [["p000000", "p000001", "p000002", "p000003"]]


def test_spaced_texts_give_the_terms_of_tokens(spark):
    texts = ["", "  A-b c ", "x" * 40 + " " + "y" * 41, "Ñandú É1 two\tthree", None, "ÄÖ" * 10 + " " + "Ä" * 21]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    rows = df.select("i", lexical.tokens("text").alias("t"), lexical.spaced("text").alias("s")).orderBy("i").toArrow().combine_chunks()
    row, pos, flat, dl = lexical.split_terms(rows.column("s").combine_chunks())
    want = [t or [] for t in rows.column("t").to_pylist()]
    assert flat.to_pylist() == [w for t in want for w in t] and dl.tolist() == [len(t) for t in want]
    assert row.tolist() == [i for i, t in enumerate(want) for _ in t] and pos.tolist() == [k for t in want for k in range(len(t))]


def test_lines_with_and_without_carriage_returns(spark):
    from siftwell.operators.lines import line_array

    df = spark.createDataFrame([("a\r\nb\n",), ("a\nb",), ("\r\n\r",), ("",), ("\n\n",)], "c string")
    assert [r[0] for r in df.select(line_array("c")).collect()] == [["a", "b"], ["a", "b"], ["", ""], [], ["", ""]]


def test_pool_recall_by_blocks(spark, monkeypatch):
    from siftwell.operators import evaluation

    monkeypatch.setattr(evaluation, "BLOCK", 3)
    monkeypatch.setattr(evaluation, "POOL_ROWS", 8)
    r = np.random.default_rng(5)
    store = [(i, r.normal(size=4).round(1).tolist(), f"f{r.integers(5)}") for i in range(120)]
    queries, pool = [*store[:9], (9, store[0][1], "alone"), (10, None, "f1")], store[9:]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = evaluation.pool_recall(frame(queries, "query_id long, q array<double>, file string"), frame([*pool, (500, None, "f1"), (501, [1.0], "f2")], "item long, embedding array<double>, file string"))
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    want = []
    for _, q, file in queries:
        scores = [(round(float(np.dot(q, e)), 6), f == file) for _, e, f in pool] if q else []
        best = max((s for s, own in scores if own), default=None)
        want.append(10**6 if best is None else sum(s > best for s, own in scores if not own))
    row = got.first()
    assert row.queries == len(queries)
    assert [row.recall_1, row.recall_3, row.recall_10] == [round(sum(b < k for b in want) / len(want), 6) for k in (1, 3, 10)]


def test_index_of_many_segments(spark, tmp_path, monkeypatch):
    from siftwell.operators import index as stored

    monkeypatch.setattr(stored, "CHUNKS", 40)
    monkeypatch.setattr(stored, "STEP", 16)
    rows, queries = corpus(), [(0, "oak"), (1, "ash birch"), (2, "fir elm oak")]
    index = stored.StoredIndex(spark, str(tmp_path / "index"), fields=("text",))
    index.add(spark.createDataFrame(rows, CHUNK).repartition(3))
    changed = [(p, s, e, b, t + " yew") for p, s, e, b, t in rows if p in ("p3", "p5")]
    index.add(spark.createDataFrame(changed, CHUNK), spark.createDataFrame([("p7",)], "path string"))
    # an add that ended before its marks doesn't count
    late = stored._segment(*_late(), ["text"], 9)
    spark.createDataFrame([x for b in late for x in b.to_pylist()], stored.SEGMENTS).write.mode("append").parquet(f"{index.place}/segments")
    live = [r for r in rows if r[0] not in ("p3", "p5", "p7")] + changed
    assert index._segments().where("field is null").count() > 15
    for place in (index, index.compact(str(tmp_path / "packed"))):
        made: dict = {}
        for r in place.search(spark.createDataFrame(queries, ASK), 7).orderBy("query_id", "rank").collect():
            made.setdefault(r.query_id, []).append((r.score, r.path, r.start))
        assert made == brute(live, queries, 7)


def _late():
    import pyarrow as pa

    return pa.table({"path": ["late"], "start": [1], "end": [1], "breadcrumb": [""]}), [pa.array(["oak oak"])]


def test_index_is_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from siftwell.operators.index import StoredIndex

    plans, parquet = {}, DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: plans.update({path.rsplit("/", 1)[-1]: plan(self._df)}) or parquet(self, path, *a, **k))
    StoredIndex(spark, str(tmp_path / "index")).add(spark.createDataFrame(corpus(20), CHUNK))
    assert not [p for name, p in plans.items() if name != "marks" and "Exchange" in p] and len(plans) == 2


@pytest.mark.parametrize("name", ["hard_negatives", "rrf_lexical_dedupe", "bm25_batch", "hit_filter"])
def test_queries_score_chunks_where_they_are(spark, name):
    from siftwell.plans import registry

    p = plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "MapInArrow" in p and "sum(w" not in p


@pytest.mark.parametrize("name", ["index_sync", "lenient_query"])
def test_queries_score_segments_where_they_meet(spark, name):
    from siftwell.plans import registry

    p = plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "FlatMapGroupsInArrow" in p and "hashpartitioning(term" not in p

"""The stored index, walks, sinks and settings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftwell.operators import chunking, evaluation, fusion, lexical, vectors
from siftwell.operators.index import StoredIndex
from siftwell.plans import fixtures
from siftwell.sources import sinks, workspace

ASK = "query_id long, query string"


def found(index, *queries):
    rows = index.search(index.spark.createDataFrame(list(enumerate(queries)), ASK), 10).orderBy("query_id", "rank").collect()
    return [[r.path for r in rows if r.query_id == k] for k in range(len(queries))]


def test_index_generations(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "index"))
    assert found(index, "token") == [[]]
    index.add(chunking.windows(fixtures.workspace(spark)))
    assert found(index, "credentials", "rotation keys", "nothing") == [["docs/secrets.md"], ["docs/secrets.md"], []]
    changed = spark.createDataFrame([("docs/secrets.md", "only apples\n"), ("new.txt", "credentials here\n")], "path string, content string")
    index.add(chunking.windows(changed), spark.createDataFrame([("src/router.py",)], "path string"))
    assert found(index, "credentials", "rotation", "dispatch", "apples") == [["new.txt"], [], [], ["docs/secrets.md"]]
    assert index.generation() == 2
    packed = index.compact(str(tmp_path / "packed"))
    assert found(packed, "credentials", "dispatch") == [["new.txt"], []] and packed.generation() == 1


def test_index_searches_both_fields_as_the_chunks_do(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "index"))
    chunks = chunking.code_symbols(fixtures.workspace(spark))
    index.add(chunks)
    ask = spark.createDataFrame([(0, "verify token dispatch")], ASK)
    key = lambda df: [(r.path, r.start, r.score) for r in df.orderBy("rank").collect()]
    assert key(index.search(ask, 10)) == key(lexical.search(chunks, ask, 10))


def test_lenient_queries_never_fail(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "index"))
    note = spark.createDataFrame([("note.md", "adopt foreign host pthread into NT thread allocate TEB\n")], "path string, content string")
    index.add(chunking.windows(note))
    odd = ["thread: foo", "a:b:c", '"unbalanced', "(unbalanced", "-leading minus", "", '""', ":", "-", "((("]
    assert found(index, "adopt foreign host pthread into NT thread: allocate TEB", *odd) == [["note.md"], *[[] for _ in odd]]
    assert found(index, '"nt thread"', '"thread nt"', "nt-thread", "thread-nt", "adopt -teb") == [["note.md"], [], ["note.md"], [], []]


def test_roots_and_settings(tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert workspace.valid_root(str(tmp_path)) == str(tmp_path)
    assert workspace.valid_root(str(tmp_path / "a.txt"), file_too=True)
    for bad in ("relative", str(tmp_path / "none"), str(tmp_path / "a.txt")):
        with pytest.raises(ValueError):
            workspace.valid_root(bad)
    text = "# x\nexport A=1\nB='two words'\nA = \"3\"\nbroken\n"
    assert workspace.assignments(text) == {"A": "3", "B": "two words"}
    assert workspace.setting("A", {"A": "9"}, [text]) == "9" and workspace.setting("B", {}, ["", text]) == "two words" and workspace.setting("C", {}, [text]) is None


def test_sinks(spark, tmp_path):
    place = str(tmp_path / "stale")
    assert not sinks.is_stale(spark, place)
    sinks.mark_stale(spark, place)
    assert sinks.is_stale(spark, place)
    sinks.clear_stale(spark, place)
    assert not sinks.is_stale(spark, place)
    assert sinks.notes(False, False, False) and not sinks.notes(True, False, False) and len(sinks.notes(True, True, True)) == 2
    hits = spark.createDataFrame([(0, 2, "b"), (0, 1, "a"), (1, None, None)], "query_id long, rank long, path string")
    got = {r.query_id: r.json for r in sinks.as_envelope(hits, ["old"]).collect()}
    assert got == {0: '{"notes":["old"],"hits":[{"rank":1,"path":"a"},{"rank":2,"path":"b"}]}', 1: '{"notes":["old"],"hits":[]}'}
    chunks = chunking.windows(fixtures.workspace(spark))
    sinks.dump_chunks(chunks, str(tmp_path / "dump"))
    assert spark.read.json(str(tmp_path / "dump")).count() == chunks.count()
    triples = spark.createDataFrame([("q", "src/auth.py", 1, 13, 1), ("q", "gone", 1, 2, 0)], "query string, path string, start long, `end` long, label int")
    texts = {r.path: r.text for r in sinks.pairs(triples, chunks, str(tmp_path / "pairs")).collect()}
    assert texts["src/auth.py"] == fixtures.AUTH.rstrip("\n") and texts["gone"] is None


def test_evaluation_takes_a_search(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "index"))
    index.add(chunking.windows(fixtures.workspace(spark)))
    out = evaluation.report(evaluation.evaluate_with(fixtures.cases(spark), index.search)).first()
    assert out.cases == 8 and out.recall_3 >= 0.8 and out.empty_correct == 2


def test_collected_and_fallback(spark):
    queries = spark.createDataFrame([(0, "credentials"), (1, "zebra")], ASK)
    chunks = chunking.windows(fixtures.workspace(spark))
    lex = lexical.search(chunks, queries, 10)
    only = fusion.collected(lex, None)
    assert [(r.path, r.vector_rank, r.source) for r in only.collect()] == [("docs/secrets.md", None, "bm25")]
    live = spark.createDataFrame([("1", "x.txt", 1, 1, "", 1), ("0", "y.txt", 1, 1, "", 1)], "query_id string, path string, start long, `end` long, breadcrumb string, rank long")
    both = fusion.with_fallback(only, queries, live)
    assert {(r.query_id, r.path, r.source) for r in both.collect()} == {("0", "docs/secrets.md", "bm25"), ("1", "x.txt", "rg")}
    assert fusion.kept_hits(both, langs=["markdown"]).count() == 1


def test_vector_batch_of_odd_rows(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [1.0, 0.0])], "id long, embedding array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, q array<double>")
    got = vectors.top_batch(store, queries, 2, ["id"]).orderBy("rank").collect()
    assert [(r.id, r.score, r["rank"]) for r in got] == [(1, 1.0, 1), (5, 1.0, 2)]
    assert vectors.top_batch(store, queries.limit(0), 2, ["id"]).count() == 0
    assert vectors.in_order(store.select(F.lit("a").alias("rel"), F.col("id").alias("start"), F.col("id").alias("end"), F.lit("").alias("breadcrumb"))).first().start == 1

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import braces, chunking, evaluation, fusion, lexical, lines, rerank, skills, sync, vectors
from siftwell.plans import fixtures, registry
from siftwell.sources import workspace
from siftwell.streaming import watch


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_patterns():
    assert T.normalize_pattern('  "foo bar" ') == "foo bar"
    assert T.normalize_pattern('"a"b"') == '"a"b"'
    assert T.normalize_pattern('""') == '""' and T.normalize_pattern('`a`') == '`a`'
    with pytest.raises(ValueError):
        T.extensions_of(["cobol"])


def test_literal_is_not_a_regex(spark):
    f = spark.createDataFrame([("a.txt", "foo.bar\nfooxbar\n"), ("b.txt", "x\0foo.bar")], "path string, content string")
    assert [(r.path, r.line) for r in lines.search(f, "foo.bar").collect()] == [("a.txt", 1)]
    assert lines.search(f, "foo.bar", regex=True).count() == 2
    assert lines.search(f, "FOO.BAR", ignore_case=True).count() == 1
    assert lines.search(f, "  ").count() == 0


def test_globs(spark):
    paths = ["src/a.rs", "src/b/c.py", "docs/x.md"]
    assert values(spark, T.keeps_globs("x", ["*.rs"]), paths) == [True, False, False]
    assert values(spark, T.keeps_globs("x", ["!docs/**"]), paths) == [True, True, False]
    assert values(spark, T.keeps_globs("x", []), paths) == [True, True, True]


def test_route(spark):
    rows = ['"exact words"', "foo::bar", "read_file", "how do tokens rotate"]
    assert values(spark, T.route("x"), rows) == ["literal", "literal", "identifier", "intent"]


def test_cut_bytes(spark):
    assert values(spark, T.cut_bytes("x", 3), ["aéé", "ab"]) == ["aé", "ab"]
    assert values(spark, T.cut_bytes("x", 2), ["aéé"]) == ["a"]


def test_redaction(spark):
    rows = ["mail me@example.org now", 'api_key = "abc def" x', "plain"]
    assert values(spark, T.redacted("x"), rows) == ["mail [redacted] now", "api_key = [redacted] x", "plain"]
    assert values(spark, T.redacted("x", strict=True), ["Authorization: Bearer abc"]) == ["Authorization: [redacted] [redacted]"]


@pytest.mark.parametrize("n,size,step,want", [(400, 150, 135, [(1, 150), (136, 285), (271, 400)]), (120, 50, 40, [(1, 50), (41, 90), (81, 120)]), (3, 5, 4, [(1, 3)])])
def test_windows(spark, n, size, step, want):
    f = spark.createDataFrame([("a", "\n".join(map(str, range(n)))), ("empty", "")], "path string, content string")
    assert [(r.start, r.end) for r in chunking.windows(f, size, step).orderBy("start").collect()] == want


def test_sections(spark):
    rows = {r.breadcrumb: (r.start, r.end) for r in chunking.sections(fixtures.workspace(spark).where("path LIKE '%.md'")).collect()}
    assert rows["(preamble)"] == (1, 2)
    assert rows["Secret storage"][1] == rows["Secret storage > Rotation"][1]
    assert "Backups" in rows


def test_symbols_and_header(spark):
    f = fixtures.workspace(spark)
    names = {r.breadcrumb for r in chunking.python_symbols(f).collect()}
    assert {"TokenGuard", "TokenGuard > verify", "decode_claims", "dispatch"} <= names
    h = chunking.headers(f).collect()
    assert [(r.path, r.start, r.end) for r in h] == [("src/auth.py", 1, 2)]


def test_symbols_and_calls_of_brace_languages(spark):
    f = fixtures.building(spark)
    got = {(r.path, r.breadcrumb): (r.start, r.end) for r in braces.symbols(f).collect()}
    assert got == {
        ("src/door.rs", "Door"): (1, 1),
        ("src/door.rs", "impl Door"): (3, 8),
        ("src/door.rs", "impl Door > knock"): (4, 7),
        ("src/door.rs", "answer"): (10, 10),
        ("src/lift.ts", "Lift"): (1, 3),
        ("src/lift.ts", "call"): (5, 8),
        ("src/lift.ts", "call > wait"): (6, 6),
        ("src/lift.ts", "Floor"): (10, 10),
        ("src/hall.go", "Hall"): (4, 6),
        ("src/hall.go", "Seats"): (9, 11),
        ("src/Stair.java", "Stair"): (1, 5),
        ("src/Stair.java", "Stair > name"): (2, 3),
        ("src/Stair.java", "Stair > Side"): (4, 4),
    }
    calls = {(r.caller, r.callee) for r in braces.rust_calls(f).collect()}
    assert calls == {("impl Door > knock", "log"), ("impl Door > knock", "answer")}
    assert braces.declarations("fn a() {", "rust") == braces.declarations("", "go") == []
    assert {r.kind for r in chunking.extract(f).collect()} == {"symbol"}
    broken = spark.createDataFrame([("a.rs", "fn a() {"), ("b.rs", None)], "path string, content string")
    assert [(r.path, r.kind) for r in chunking.extract(broken).collect()] == [("a.rs", "window")]


def test_oversized(spark):
    df = spark.createDataFrame([("a", 1, 102, "symbol", "f", "\n".join("x" * 102)), ("a", 1, 81, "symbol", "g", "\n".join("x" * 81))], chunking.CHUNK)
    rows = [(r.breadcrumb, r.start, r.end) for r in chunking.split_oversized(df).orderBy("breadcrumb").collect()]
    assert rows == [("f [1/2]", 1, 80), ("f [2/2]", 66, 102), ("g", 1, 81)]


def test_greedy_credit(spark):
    schema = "query_id string, path string, start long, end long, breadcrumb string, rank long"
    lex = spark.createDataFrame([("q", "a", 1, 10, "", 1), ("q", "a", 11, 20, "", 2)], schema)
    vec = spark.createDataFrame([("q", "a", 5, 14, "", 1), ("q", "a", 9, 12, "", 2), ("q", "b", 1, 5, "", 3)], schema)
    got = {(r.path, r.start): (r.lexical_rank, r.vector_rank, r.source) for r in fusion.fused(lex, vec).collect()}
    assert got[("a", 1)] == (1, 1, "bm25+vec")  # 6 of 10 lines against 4
    assert got[("a", 11)] == (2, 2, "bm25+vec")
    assert got[("b", 1)] == (None, 3, "vec")


def test_retrieval_gate(spark):
    chunks = chunking.extract(fixtures.workspace(spark))
    cases = fixtures.cases(spark)
    hits = lexical.search(chunks, cases.select(F.col("id").alias("query_id"), "query"), 20).withColumnRenamed("query_id", "id")
    row = evaluation.report(evaluation.outcomes(cases, hits.select("id", "path", "rank"))).first()
    assert row.recall_3 >= 0.9 and row.empty_correct == 2 and row.false_abstentions == 0


def test_vector_sync(spark):
    schema = "rel string, start long, end long, breadcrumb string, text string"
    old = spark.createDataFrame([("a", 1, 2, "", "one"), ("b", 1, 2, "", "two"), ("gone", 1, 2, "", "x")], schema)
    store = vectors.embedded(old, fixtures.length_embedding)
    now = spark.createDataFrame([("a", 1, 2, "", "one"), ("b", 1, 2, "", "three")], schema)
    out = {r.rel: r.embedding for r in vectors.sync(now, store, fixtures.length_embedding).collect()}
    assert set(out) == {"a", "b"} and out["b"][0] == pytest.approx(5 / 26**0.5)


def test_manifest(spark, tmp_path):
    (tmp_path / "w").mkdir()
    for name, body in (("a.py", "x"), ("b.txt", "yy"), ("Cargo.lock", "z")):
        (tmp_path / "w" / name).write_text(body)
    root, store = str(tmp_path / "w"), str(tmp_path / "m")
    files = lambda: workspace.scan(spark, root, content=False).where(workspace.indexable("path"))
    assert workspace.read_manifest(spark, store).count() == 0
    workspace.write_manifest(files(), store)
    assert sync.stale(files(), workspace.read_manifest(spark, store)).first().stale is False
    (tmp_path / "w" / "a.py").write_text("changed")
    (tmp_path / "w" / "b.txt").unlink()
    got = {r.path: r.status for r in sync.diff(files(), workspace.read_manifest(spark, store)).collect()}
    assert got == {"a.py": "changed", "b.txt": "removed"}


def test_rerank_keeps_order_on_failure():
    class Reverse:
        def scores(self, query, docs):
            return [(i, float(i)) for i in range(len(docs))]

    class Broken:
        def scores(self, query, docs):
            raise TimeoutError("slow")

    hits = [{"breadcrumb": "", "text": str(i), "n": i} for i in range(25)]
    assert [h["n"] for h in rerank.reranked("q", hits, Reverse())][:2] == [19, 18]
    assert [h["n"] for h in rerank.reranked("q", hits, Broken())] == list(range(25))


def test_front_matter():
    m = skills.front_matter("---\nname: 'x'\ndescription: >\n  one\n  two\n---\nbody")
    assert m == {"name": "x", "description": "one two"}
    with pytest.raises(ValueError):
        skills.front_matter("no")


def test_sessions_stream(spark, tmp_path):
    rows = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 00:00:09"]), "path": ["a/x.py", "target/y", "target/z"]})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, path string").parquet(str(tmp_path / "in"))
    q = watch.sessions(stream).writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    got = sorted((r.n_events, r.fires) for r in spark.table("bursts").collect())
    assert got == [(1, False), (2, True)]


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_vector_batch_takes_every_fiftieth_row(spark):
    sf = "/root/testdata/sf0.001"
    ids = [r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()]
    got = registry.QUERIES["vector_batch"](spark, sf).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {i: 10 for i in ids if i % 50 == 0}

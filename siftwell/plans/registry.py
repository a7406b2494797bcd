"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import braces, chains, chunking, evaluation, fusion, lexical, lines, mining, skills, sync, vectors
from siftwell.operators.index import StoredIndex
from siftwell.plans import fixtures
from siftwell.sources import sinks, workspace
from siftwell.streaming import watch

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str) -> DataFrame:
    return workspace.documents_as_files(table(spark, sf, "documents"))


FILES = "files AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, text AS content FROM documents)"
LINES = FILES + r""", arr AS (SELECT path, list_transform(string_split(regexp_replace(content, '\n$', ''), chr(10)), lambda x: regexp_replace(x, '\r$', '')) AS l FROM files WHERE content <> ''),
ln AS (SELECT path, i AS line, l[i] AS text FROM arr, unnest(range(1, len(l) + 1)) AS u(i))"""


def chunks_sql(size: int, step: int) -> str:
    return LINES + f""", w AS (SELECT path, l, len(l) AS n, unnest(range(0, CASE WHEN len(l) <= {size} THEN 1 ELSE 1 + ceil((len(l) - {size}) / {step}.0)::BIGINT END)) AS k FROM arr),
chunks AS (SELECT path, k * {step} + 1 AS start, least(n, k * {step} + {size}) AS "end", array_to_string(l[k * {step} + 1 : k * {step} + {size}], chr(10)) AS text FROM w)"""


# --- exact search ---------------------------------------------------------------


@query(f"WITH {LINES} SELECT path, line, text FROM ln WHERE contains(text, 'License')")
def exact_literal(spark, sf):
    return lines.search(files(spark, sf), "License", limit=None)


@query(f"WITH {LINES} SELECT path, line, text FROM ln WHERE regexp_matches(text, '(?i)license, version 3\\.')")
def exact_ci(spark, sf):
    return lines.search(files(spark, sf), "'LICENSE, VERSION 3.'", ignore_case=True, limit=None)


@query(f"WITH {LINES} SELECT path, line, text FROM ln WHERE regexp_matches(text, '[0-9]{{3}}-[0-9]{{4}}')")
def exact_regex(spark, sf):
    return lines.search(files(spark, sf), r"[0-9]{3}-[0-9]{4}", regex=True, limit=None)


@query(f"WITH {LINES} SELECT path, line, text FROM ln WHERE contains(text, 'the') ORDER BY path, line LIMIT 100")
def exact_topn(spark, sf):
    return lines.search(files(spark, sf), "the")


@query(f"WITH {LINES} SELECT path, line, text FROM ln WHERE regexp_matches(text, '(?i)reserved|license') ORDER BY path, line LIMIT 100")
def fallback_search(spark, sf):
    return lines.fallback(files(spark, sf), ["reserved", "license"])


_EXTENSIONS = ("md", "MD", "markdown", "ts", "tsx", "js", "py", "rs", "txt", "md.bak", "mts")


@query(f"WITH p AS (SELECT page_id, 'dir.ts/page_' || page_id || '.' || ({list(_EXTENSIONS)})[page_id % {len(_EXTENSIONS)} + 1] AS path FROM pages) SELECT page_id, path FROM p WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('md', 'markdown', 'js', 'mjs', 'cjs', 'ts', 'mts', 'cts', 'tsx', 'jsx')")
def lang_filter(spark, sf):
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTENSIONS]), (F.col("page_id") % len(_EXTENSIONS) + 1).cast("int"))
    paths = table(spark, sf, "pages").select("page_id", F.concat(F.lit("dir.ts/page_"), F.col("page_id").cast("string"), F.lit("."), ext).alias("path"))
    return paths.where(T.in_languages("path", ["markdown", "typescript"]))


@query(f"WITH {FILES} SELECT path FROM files WHERE regexp_matches(path, '^src1[^/]*/') AND NOT regexp_matches(path, '^(?:.*/)?doc_[^/]*7\\.txt$')")
def glob_filter(spark, sf):
    return files(spark, sf).where(T.keeps_globs("path", ["src1*/**", "!doc_*7.txt"])).select("path")


@query(f"WITH {FILES} SELECT path, contains(content, chr(0)) OR len(list_filter(string_split(content, chr(10)), lambda x: strlen(x) > 8192)) > 0 AS rejected FROM files")
def binary_longline_reject(spark, sf):
    return files(spark, sf).select("path", workspace.accepted_content("content", False).alias("rejected"))


@query(f"WITH {FILES} SELECT path, len(list_filter(string_split(path, '/'), lambda x: x IN ('.git', 'target', 'node_modules', '.siftwell'))) = 0 AS relevant FROM files")
def watch_paths(spark, sf):
    return files(spark, sf).select("path", workspace.watch_relevant("path").alias("relevant"))


# --- chunks ---------------------------------------------------------------------


def _windows(size: int, step: int):
    return lambda spark, sf: chunking.windows(files(spark, sf), size, step).select("path", "start", "end", "breadcrumb", F.length("text").cast("long").alias("n_chars"))


for _name, _size, _step in (("windows_lexical", 150, 135), ("windows_vector", 50, 40), ("windows_small", 5, 4)):
    QUERIES[_name] = _windows(_size, _step)
    ORACLES[_name] = f"WITH {chunks_sql(_size, _step)} SELECT path, start, \"end\", 'lines ' || start || '-' || \"end\" AS breadcrumb, length(text)::BIGINT AS n_chars FROM chunks"


@query(
    f"""WITH {chunks_sql(5, 4)}, pts AS (SELECT path, line FROM ln WHERE contains(text, 'License')), met AS (SELECT p.path, p.line, c.start, c."end",
    row_number() OVER (PARTITION BY p.path, p.line ORDER BY c."end" - c.start, c.start) AS n FROM pts p JOIN chunks c ON p.path = c.path AND c.start <= p.line AND p.line <= c."end")
    SELECT path, line, start, "end" FROM met WHERE n = 1"""
)
def enclosing_chunk(spark, sf):
    f = files(spark, sf)
    points = lines.search(f, "License", limit=None).select("path", "line")
    return chunking.enclosing(chunking.windows(f, 5, 4), points).select("path", "line", "start", "end")


def _golden_chunks(rows: list[tuple]) -> str:
    return f'SELECT path, start::BIGINT AS start, "end"::BIGINT AS "end", kind, breadcrumb FROM ({fixtures.values(rows)}) t(path, start, "end", kind, breadcrumb)'


def _spans(chunks: DataFrame) -> DataFrame:
    return chunks.select("path", "start", "end", "kind", "breadcrumb")


@query(
    _golden_chunks(
        [
            ("docs/secrets.md", 1, 2, "section", "(preamble)"),
            ("docs/secrets.md", 3, 10, "section", "Secret storage"),
            ("docs/secrets.md", 7, 10, "section", "Secret storage > Rotation"),
            ("docs/secrets.md", 11, 13, "section", "Backups"),
            ("src/auth.py", 1, 1, "section", "Token checks for every request."),
            ("src/auth.py", 2, 13, "section", "Used by the router."),
            ("src/router.py", 1, 16, "window", "lines 1-16"),
            ("odd.md", 1, 1, "section", "(preamble)"),
            ("odd.md", 2, 3, "section", "Deep"),
            ("odd.md", 4, 6, "section", "Deep > Less deep"),
            ("odd.md", 7, 9, "section", ""),
            ("odd.md", 9, 9, "section", " > Under it"),
        ]
    )
)
def sections(spark, sf):
    odd = spark.createDataFrame([("odd.md", fixtures.HEADINGS)], "path string, content string")
    return _spans(chunking.sections(fixtures.workspace(spark).unionByName(odd)))


@query(_golden_chunks([("src/auth.py", 1, 2, "section", "(header)")]))
def header_block(spark, sf):
    return _spans(chunking.headers(fixtures.workspace(spark)))


@query(
    _golden_chunks(
        [
            ("src/auth.py", 4, 8, "symbol", "TokenGuard"),
            ("src/auth.py", 7, 8, "symbol", "TokenGuard > verify"),
            ("src/auth.py", 11, 13, "symbol", "decode_claims"),
            ("src/router.py", 4, 8, "symbol", "dispatch"),
            ("src/router.py", 11, 12, "symbol", "reject"),
            ("src/router.py", 15, 16, "symbol", "handle"),
        ]
    )
)
def symbols_python(spark, sf):
    return _spans(chunking.split_oversized(chunking.python_symbols(fixtures.workspace(spark))))


@query(
    _golden_chunks(
        [
            ("src/door.rs", 1, 1, "symbol", "Door"),
            ("src/door.rs", 3, 8, "symbol", "impl Door"),
            ("src/door.rs", 4, 7, "symbol", "impl Door > knock"),
            ("src/door.rs", 10, 10, "symbol", "answer"),
            ("src/lift.ts", 1, 3, "symbol", "Lift"),
            ("src/lift.ts", 5, 8, "symbol", "call"),
            ("src/lift.ts", 6, 6, "symbol", "call > wait"),
            ("src/lift.ts", 10, 10, "symbol", "Floor"),
            ("src/hall.go", 4, 6, "symbol", "Hall"),
            ("src/hall.go", 9, 11, "symbol", "Seats"),
            ("src/Stair.java", 1, 5, "symbol", "Stair"),
            ("src/Stair.java", 2, 3, "symbol", "Stair > name"),
            ("src/Stair.java", 4, 4, "symbol", "Stair > Side"),
        ]
    )
)
def symbols_braces(spark, sf):
    return _spans(chunking.split_oversized(braces.symbols(fixtures.building(spark))))


_CALLS = [
    ("src/auth.py", "TokenGuard > verify", "decode_claims", "src/auth.py"),
    ("src/router.py", "dispatch", "TokenGuard", "src/auth.py"),
    ("src/router.py", "dispatch", "verify", "src/auth.py"),
    ("src/router.py", "dispatch", "reject", "src/router.py"),
    ("src/router.py", "dispatch", "handle", "src/router.py"),
]


@query("SELECT * FROM (" + fixtures.values([*_CALLS, ("src/door.rs", "impl Door > knock", "answer", "src/door.rs")]) + ") t(path, caller, callee, target_path)")
def call_resolution(spark, sf):
    f = fixtures.workspace(spark).unionByName(fixtures.building(spark))
    symbols = chunking.code_symbols(f).select("path", T.simple_name("breadcrumb").alias("name"))
    return chains.resolve(chunking.code_calls(f), symbols)


@query(_golden_chunks([(p, *((7, 8) if p == "src/auth.py" else (4, 8)), "chain", f"{caller} > calls > {callee}") for p, caller, callee, _ in _CALLS]))
def chain_chunks(spark, sf):
    f = fixtures.workspace(spark)
    chunks = chunking.code_symbols(f)
    resolved = chains.resolve(chunking.code_calls(f), chunks.select("path", T.simple_name("breadcrumb").alias("name")))
    return _spans(chains.chain_chunks(resolved, chunks))


# --- lexical --------------------------------------------------------------------

TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' AND strlen(t) <= 40)"
ASKED = f"asked AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark))"


def bm25_sql(asked: str, size: int, step: int) -> str:
    return f"""WITH {chunks_sql(size, step)}, {asked},
    tok AS (SELECT path, start, "end", {TOKENS.format('text')} AS t FROM chunks),
    stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
    tf AS (SELECT path, start, "end", len(t) AS dl, term, count(*) AS tf FROM (SELECT path, start, "end", t, unnest(t) AS term FROM tok) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    s AS (SELECT query_id, path, start, "end", round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM tf JOIN df USING (term) JOIN asked USING (term), stats GROUP BY query_id, path, start, "end"),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, start, "end") AS rank FROM s)"""


def benchmark_queries(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _bm25(spark, sf, queries: DataFrame, limit: int = 10) -> DataFrame:
    chunks = chunking.windows(files(spark, sf))
    return lexical.search(chunks, queries, limit, fields=("text",)).select("query_id", "path", "start", "end", "score", "rank")


@query(bm25_sql(ASKED, 150, 135) + ' SELECT query_id, path, start, "end", score, rank FROM ranked WHERE rank <= 10')
def bm25_batch(spark, sf):
    return _bm25(spark, sf, benchmark_queries(spark, sf))


@query(bm25_sql("asked AS (SELECT 0::BIGINT AS query_id, unnest(['gnu', 'license', 'public']) AS term)", 150, 135) + ' SELECT query_id, path, start, "end", score, rank FROM ranked WHERE rank <= 10')
def bm25_top(spark, sf):
    return _bm25(spark, sf, spark.createDataFrame([(0, "GNU public-license")], "query_id long, query string"))


@query(f"WITH {FILES}, tf AS (SELECT path, term, count(*) AS tf FROM (SELECT path, unnest({TOKENS.format('content')}) AS term FROM files) GROUP BY ALL) SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term")
def term_stats(spark, sf):
    f = files(spark, sf).select("path", F.lit(1).alias("start"), F.lit(1).alias("end"), F.lit("").alias("breadcrumb"), F.col("content").alias("text"))
    return lexical.term_stats(f)


@query(f"WITH {FILES}, t AS (SELECT path, ' ' || array_to_string({TOKENS.format('content')}, ' ') || ' ' AS s FROM files) SELECT path FROM t WHERE contains(s, ' gnu general public license ')")
def phrase_match(spark, sf):
    f = files(spark, sf).select("path", F.lit(1).alias("start"), F.lit(1).alias("end"), F.lit("").alias("breadcrumb"), F.col("content").alias("text"))
    return lexical.phrase(f, ["gnu", "general", "public", "license"]).select("path")


# --- vectors --------------------------------------------------------------------


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 50")
def vector_top(spark, sf):
    store = table(spark, sf, "embeddings")
    q = store.where("vec_id = 0").select("embedding").first()[0]
    return vectors.top(store, q, 50, ["vec_id"])


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10"""
)
def vector_batch(spark, sf):
    """Every row whose id is divisible by 50 as a query, against all rows."""
    store = table(spark, sf, "embeddings")
    queries = store.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.top_batch(store, queries, 10, ["vec_id"])


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS total, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS first FROM embeddings")
def normalize_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", T.normalized("embedding").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.round(total, 5).alias("total"), F.round(F.col("v")[0], 5).alias("first"))


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS file FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT vec_id AS item, label AS file, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 <> 0),
    s AS (SELECT query_id, q.file AS mine, p.file, round(list_dot_product(e, q), 6) AS score FROM q, p), o AS (SELECT query_id, max(score) AS best FROM s WHERE file = mine GROUP BY query_id),
    b AS (SELECT query_id, count(*) FILTER (file <> mine AND score > best) AS better FROM s JOIN o USING (query_id) GROUP BY query_id), r AS (SELECT better FROM q LEFT JOIN b USING (query_id))
    SELECT count(*) AS queries, round(avg((coalesce(better < 1, FALSE))::INT), 6) AS recall_1, round(avg((coalesce(better < 3, FALSE))::INT), 6) AS recall_3, round(avg((coalesce(better < 10, FALSE))::INT), 6) AS recall_10 FROM r"""
)
def pool_recall(spark, sf):
    store = table(spark, sf, "embeddings")
    queries = store.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("file"))
    pool = store.where("vec_id % 50 <> 0").select(F.col("vec_id").alias("item"), F.col("label").alias("file"), "embedding")
    return evaluation.pool_recall(queries, pool)


# --- fusion ---------------------------------------------------------------------


@query(bm25_sql(ASKED, 5, 4) + """, l AS (SELECT query_id, path, (start // 8) * 8 AS start, rank FROM ranked WHERE rank <= 50)
    SELECT query_id, path, start, round(sum(2.0 / (20 + rank)), 6) AS score, min(rank) AS lexical_rank FROM l GROUP BY query_id, path, start""")
def rrf_lexical_dedupe(spark, sf):
    hits = lexical.search(chunking.windows(files(spark, sf), 5, 4), benchmark_queries(spark, sf), 50, fields=("text",))
    coarse = hits.withColumn("start", F.floor(F.col("start") / 8) * 8).withColumn("end", F.col("start") + 7).withColumn("breadcrumb", F.lit(""))
    return fusion.merged_lexical(coarse).select("query_id", "path", "start", F.round("lexical_sum", 6).alias("score"), "lexical_rank")


@query("SELECT r AS id, CASE WHEN r % 5 = 0 THEN 'ast' WHEN r % 2 = 0 AND r % 3 = 0 THEN 'bm25+vec' WHEN r % 2 = 0 THEN 'bm25' WHEN r % 3 = 0 THEN 'vec' ELSE 'rg' END AS source FROM range(100) t(r)")
def source_label(spark, sf):
    rank = lambda k: F.when(F.col("id") % k == 0, 1)
    return spark.range(100).select("id", T.source_label(rank(2), rank(3), rank(5)).alias("source"))


def _two_lists(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A lexical list over small windows and, in the role of a vector list, one over larger windows."""
    f, queries = files(spark, sf), benchmark_queries(spark, sf)
    return tuple(lexical.search(chunking.windows(f, *w), queries, fusion.depth(10), fields=("text",)) for w in ((5, 4), (8, 6)))


@query()
def rrf_overlap(spark, sf):
    return fusion.hybrid(*_two_lists(spark, sf)).select("query_id", "path", "start", "end", "lexical_rank", "vector_rank", F.round("score", 6).alias("score"), "source", "rank")


# --- routing, text --------------------------------------------------------------


_ROUTE = r"""CASE WHEN length(q) > 2 AND left(q, 1) = right(q, 1) AND left(q, 1) IN ('"', '''') AND regexp_matches(q[2:-2], '\S') AND NOT contains(q[2:-2], left(q, 1)) THEN 'literal'
    WHEN contains(q, '::') AND len(list_filter(string_split(q, '::'), lambda p: NOT regexp_full_match(p, '[A-Za-z_][A-Za-z0-9_]*'))) = 0 THEN 'literal'
    WHEN regexp_full_match(q, '[A-Za-z_][A-Za-z0-9_\-./]*') THEN 'identifier' ELSE 'intent' END"""


@query(rf"WITH q AS (SELECT conv_id, turn, regexp_replace(CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN string_split(text, ' ')[1] ELSE chr(34) || text || chr(34) END, '^\s+|\s+$', '', 'g') AS q FROM conversations) SELECT conv_id, turn, {_ROUTE} AS route FROM q")
def route_queries(spark, sf):
    """Whole texts, their first words, and whole texts in quotes."""
    words = F.split("text", " ", -1)
    asked = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, words[0]).otherwise(F.concat(F.lit('"'), "text", F.lit('"')))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.route(asked).alias("route"))


@query(f"SELECT * FROM ({fixtures.values(fixtures.ROUTES)}) t(query, route)")
def route_golden(spark, sf):
    return spark.createDataFrame([(q,) for q, _ in fixtures.ROUTES], "query string").select("query", T.route("query").alias("route"))


@query(f"SELECT * FROM ({fixtures.values(fixtures.PATTERNS)}) t(pattern, searched)")
def pattern_golden(spark, sf):
    return spark.createDataFrame([(p, T.normalize_pattern(p)) for p, _ in fixtures.PATTERNS], "pattern string, searched string")


_STOP = ", ".join(f"'{w}'" for w in T.FALLBACK_STOP)


@query(
    rf"""WITH p AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[^A-Za-z0-9\-_./]+'), lambda t: strlen(t) >= 2 AND NOT (lower(t) IN ({_STOP}))) AS t FROM benchmark),
    e AS (SELECT item_id, unnest(t) AS t FROM p), o AS (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY -strlen(t), t) AS n FROM e),
    d AS (SELECT *, lag(lower(t)) OVER (PARTITION BY item_id ORDER BY n) AS prev FROM o), k AS (SELECT item_id, t, n FROM d WHERE prev IS NULL OR prev <> lower(t)),
    i AS (SELECT *, count(*) FILTER (regexp_matches(t, '[-_/.A-Z]')) OVER (PARTITION BY item_id) AS named FROM k),
    f AS (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY n) AS n FROM i WHERE named = 0 OR regexp_matches(t, '[-_/.A-Z]'))
    SELECT item_id, string_agg(t, ' ' ORDER BY n) AS terms FROM f WHERE n <= 8 GROUP BY item_id"""
)
def fallback_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.concat_ws(" ", T.fallback_terms("text")).alias("terms"))


_SECRETS = "|".join(T.SECRET_NAMES)


@query(
    rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(^|\s)[^\s@]+@[^\s@]+\.[^\s@]+', '\1[redacted]', 'g'), '(?i)([A-Za-z0-9_\-]*(?:{_SECRETS})\s*[=:]\s*)("[^"]*"|''[^'']*''|[^\s]+)', '\1[redacted]', 'g')) AS digest FROM documents"""
)
def redact_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.redacted("text")).alias("digest"))


@query("SELECT page_id, trim(regexp_replace(html, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text FROM pages")
def collapse_space(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.collapsed("html").alias("text"))


# --- sync -----------------------------------------------------------------------


def _snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders")
    base = o.select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderdate").cast("timestamp").alias("mtime"), "o_orderkey", F.col("o_custkey").alias("len"))
    old = base.where("o_orderkey % 7 <> 0").drop("o_orderkey")
    new = base.where("o_orderkey % 11 <> 0").withColumn("len", F.col("len") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).drop("o_orderkey")
    return new, old


_DIFF = """WITH d AS (SELECT 'f' || o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'new' WHEN o_orderkey % 11 = 0 THEN 'removed' WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE 'same' END AS status
    FROM (SELECT DISTINCT o_orderkey FROM orders) WHERE NOT (o_orderkey % 7 = 0 AND o_orderkey % 11 = 0))"""


@query(_DIFF + " SELECT * FROM d")
def manifest_diff(spark, sf):
    return sync.diff(*_snapshots(spark, sf))


@query(_DIFF + " SELECT count(*) FILTER (status <> 'same') > 0 AS stale, count(*) FILTER (status = 'new') AS n_new, count(*) FILTER (status = 'changed') AS n_changed, count(*) FILTER (status = 'removed') AS n_removed, count(*) FILTER (status = 'same') AS n_same FROM d")
def stale_check(spark, sf):
    return sync.stale(*_snapshots(spark, sf))


def _stores(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents").select(F.col("source").alias("rel"), F.col("doc_id").alias("start"), F.col("doc_id").alias("end"), F.col("lang").alias("breadcrumb"), "text", "doc_id")
    current = d.where("doc_id % 3 <> 0").drop("doc_id")
    store = d.where("doc_id % 4 <> 0").withColumn("text", F.when(F.col("doc_id") % 10 == 1, "old").otherwise(F.col("text"))).drop("doc_id")
    return current, store


@query("SELECT source AS rel, doc_id AS start FROM documents WHERE doc_id % 3 <> 0 AND (doc_id % 4 = 0 OR (doc_id % 10 = 1 AND text <> 'old'))")
def needs_embed(spark, sf):
    return vectors.needs_embedding(*_stores(spark, sf)).select("rel", "start")


@query("SELECT source AS rel, doc_id AS start FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0")
def retain_ids(spark, sf):
    current, store = _stores(spark, sf)
    return vectors.retained(store, current).select("rel", "start")


@query(
    """WITH d AS (SELECT source AS rel, doc_id AS start, least(strlen(text), 1500)::DOUBLE AS n FROM documents WHERE doc_id % 3 <> 0)
    SELECT rel, start, round(n / sqrt(n * n + 1), 5) AS first, round(1 / sqrt(n * n + 1), 5) AS second FROM d"""
)
def embed_sync(spark, sf):
    current, store = _stores(spark, sf)
    have = vectors.embedded(store, fixtures.length_embedding)
    return vectors.sync(current, have, fixtures.length_embedding).select("rel", "start", F.round(F.col("embedding")[0], 5).alias("first"), F.round(F.col("embedding")[1], 5).alias("second"))


# --- evaluation -----------------------------------------------------------------

_LABELLED = "SELECT doc_id::VARCHAR AS id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'plain' END AS kind, CASE WHEN quality = 1 THEN 'x' END AS expected, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 23 + 1 END AS rank, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 10 END AS hits FROM labels"


def _outcomes(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("toxic") == 1, "toxic").otherwise("plain").alias("kind"),
        F.when(F.col("quality") == 1, "x").alias("expected"),
        F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 23 + 1).alias("rank"),
        F.when(F.col("doc_id") % 4 == 0, 0).otherwise(10).alias("hits"),
    )


_RECALL = "round(avg(coalesce((rank <= {0})::INT::DOUBLE, 0.0)) FILTER (expected IS NOT NULL), 6) AS recall_{0}"


@query(f"WITH o AS ({_LABELLED}) SELECT count(*) AS cases, {', '.join(_RECALL.format(k) for k in evaluation.DEPTHS)}, round(avg(coalesce(1.0::DOUBLE / rank, 0.0)) FILTER (expected IS NOT NULL), 6) AS mrr, count(*) FILTER (expected IS NULL AND hits = 0) AS empty_correct, count(*) FILTER (expected IS NOT NULL AND hits = 0) AS false_abstentions FROM o")
def eval_recall(spark, sf):
    return evaluation.report(_outcomes(spark, sf))


@query(f"WITH o AS ({_LABELLED}) SELECT kind, {_RECALL.format(3)}, count(*) AS cases FROM o WHERE expected IS NOT NULL GROUP BY kind")
def eval_kind(spark, sf):
    return evaluation.by_kind(_outcomes(spark, sf))


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_quantiles(spark, sf):
    return evaluation.latency(table(spark, sf, "events"), "value", ["event_type"])


@query("SELECT event_type AS tool, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def log_mix(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))  # a row a tool


@query(
    """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 10 MINUTE) AS end_us, count(*) AS n_events FROM s GROUP BY user_id, k"""
)
def debounce_sessions(spark, sf):
    s = watch.sessions(table(spark, sf, "events"), by=["user_id"], gap="10 minutes")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_events")


# --- skills, mining -------------------------------------------------------------

_SKILL_STOP = ", ".join(f"'{w}'" for w in T.SKILL_STOP)
_SKILL_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) > 1 AND NOT (t IN (" + _SKILL_STOP + "))))"


@query(f"WITH t AS (SELECT doc_id, {_SKILL_TOKENS.format('text')} AS t, {_SKILL_TOKENS.format(chr(39) + 'released under the MIT license' + chr(39))} AS q FROM documents) SELECT doc_id, round(len(list_intersect(q, t)) / len(q), 6)::DOUBLE AS score FROM t")
def skill_overlap(spark, sf):
    score = T.token_overlap(T.skill_tokens(F.lit("released under the MIT license")), T.skill_tokens("text"))
    return table(spark, sf, "documents").select("doc_id", F.round(score, 6).alias("score"))


@query("SELECT 'notes' AS folder, 'release-notes' AS name, 'Write release notes from merged changes' AS description, NULL::VARCHAR AS error, 1.0::DOUBLE AS score")
def skill_rank(spark, sf):
    return skills.ranked(skills.parsed(fixtures.skill_files(spark)), "how to write release notes")


@query("SELECT 'quoted' AS folder, 'deploy' AS name, 'Ship a build' AS description, NULL::VARCHAR AS error, 0.9::DOUBLE AS score UNION ALL SELECT 'notes', 'release-notes', 'Write release notes from merged changes', NULL, 0.5")
def skill_judged(spark, sf):
    """Skill files of a scan, a judge's answers, and the floors on both."""
    scan = fixtures.skill_files(spark).select(F.concat("folder", F.lit("/SKILL.md")).alias("path"), "content")
    other = spark.createDataFrame([("deep/er/SKILL.md", "---\nname: deep\ndescription: No\n---\n"), ("notes/README.md", "x")], "path string, content string")
    answers = spark.createDataFrame([("deploy", 0.5, 0.9), ("release-notes", 0.8, 0.5), ("review", 0.4, 1.0), ("deep", 1.0, 1.0)], "name string, exists double, score double")
    return skills.judged(skills.parsed(skills.library(scan.unionByName(other))), answers, 5)


@query(bm25_sql(ASKED, 150, 135) + """, p AS (SELECT query_id, path FROM ranked WHERE rank = 1), n AS (SELECT r.query_id, r.path, r.start, r.rank FROM ranked r ANTI JOIN p USING (query_id, path) WHERE r.rank <= 12),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS neg FROM n) SELECT * FROM k WHERE neg <= 5""")
def hard_negatives(spark, sf):
    hits = _bm25(spark, sf, benchmark_queries(spark, sf), 12)
    return mining.hard_negatives(hits, hits.where("rank = 1")).select("query_id", "path", "start", "rank", "neg")


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS pick FROM documents) SELECT * FROM r WHERE pick <= 20")
def stratified_sample(spark, sf):
    return mining.stratified(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 20)


# --- stored index, walks, sinks, further evaluation -----------------------------

#: Queries of the lenient language, and their clauses: (query_id, clause, terms, excluded).
_LENIENT = ["gnu public-license", '"general public license"', "license -gnu", "thread: foo a:b:c", '"unbalanced', "-gnu", "text:license (reserved", "unknown:license rights:gnu"]
_CLAUSES = [(0, 0, "gnu", False), (0, 1, "public license", False), (1, 0, "general public license", False), (2, 0, "license", False), (2, 1, "gnu", True), (4, 0, "unbalanced", False), (5, 0, "gnu", True), (6, 0, "license", False), (6, 1, "reserved", False)]


def _index(spark, chunks: DataFrame) -> StoredIndex:
    out = StoredIndex(spark, workspace.scratch(spark, "index"), fields=("text",))
    out.add(chunks)
    return out


def _term_queries(spark, sf) -> DataFrame:
    """The benchmark's texts as plain terms, alternatives to each other."""
    return benchmark_queries(spark, sf).select("query_id", F.array_join(F.array_distinct(T.tokens("query")), " ").alias("query"))


@query(bm25_sql(ASKED, 150, 135) + ' SELECT query_id, path, start, "end", score, rank FROM ranked WHERE rank <= 10')
def index_search(spark, sf):
    """A batch of queries against an index that was written and is read back."""
    index = _index(spark, chunking.windows(files(spark, sf)))
    return index.search(_term_queries(spark, sf), 10).select("query_id", "path", "start", "end", "score", "rank")


_SYNCED = "files AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, CASE WHEN doc_id % 10 = 1 THEN text || ' gnu zebra license' ELSE text END AS content FROM documents WHERE doc_id % 7 <> 0)"


@query(bm25_sql("asked AS (SELECT 0::BIGINT AS query_id, unnest(['zebra', 'license', 'gnu']) AS term)", 150, 135).replace(FILES, _SYNCED) + ' SELECT query_id, path, start, "end", score, rank FROM ranked WHERE rank <= 50')
def index_sync(spark, sf):
    """An index after a second generation: changed files replace their old chunks, removed ones are gone."""
    docs = table(spark, sf, "documents")
    index = _index(spark, chunking.windows(files(spark, sf)))
    changed = docs.where("doc_id % 7 <> 0 AND doc_id % 10 = 1").withColumn("text", F.concat("text", F.lit(" gnu zebra license")))
    removed = workspace.documents_as_files(docs.where("doc_id % 7 = 0")).select("path")
    index.add(chunking.windows(workspace.documents_as_files(changed)), removed)
    queries = spark.createDataFrame([(0, "zebra license gnu")], "query_id long, query string")
    return index.search(queries, 50).select("query_id", "path", "start", "end", "score", "rank")


@query(
    f"""WITH {chunks_sql(150, 135)}, tok AS (SELECT path, start, "end", {TOKENS.format('text')} AS t FROM chunks), stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
    c AS (SELECT query_id::BIGINT AS query_id, clause, string_split(terms, ' ') AS w, excluded FROM ({fixtures.values([(q, c, t, int(x)) for q, c, t, x in _CLAUSES])}) v(query_id, clause, terms, excluded)),
    df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT path, start, "end", unnest(t) AS term FROM tok) GROUP BY term),
    idf AS (SELECT query_id, clause, sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM (SELECT query_id, clause, unnest(w) AS term FROM c) JOIN df USING (term), stats GROUP BY query_id, clause),
    f AS (SELECT query_id, clause, excluded, path, start, "end", len(t) AS dl, len(list_filter(range(1, len(t) - len(w) + 2), lambda i: t[i:i + len(w) - 1] = w)) AS freq FROM c, tok),
    s AS (SELECT query_id, path, start, "end", round(sum(idf * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * dl / avgdl))) FILTER (excluded = 0), 6) AS score, max(excluded) AS out FROM f JOIN idf USING (query_id, clause), stats WHERE freq > 0 GROUP BY query_id, path, start, "end"),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, start, "end") AS rank FROM s WHERE score IS NOT NULL AND out = 0)
    SELECT query_id, path, start, "end", score, rank FROM ranked WHERE rank <= 10"""
)
def lenient_query(spark, sf):
    """Phrases, fields, exclusions, and text that is no query at all."""
    index = _index(spark, chunking.windows(files(spark, sf)))
    queries = spark.createDataFrame(list(enumerate(_LENIENT)), "query_id long, query string")
    return index.search(queries, 10).select("query_id", "path", "start", "end", "score", "rank")


@query("SELECT unnest(['notes.txt', 'a/keep.log', 'a/out/x.txt', 'sub/secret.txt', 'sub/deep/notes/a.md']) AS path")
def walk_ignored(spark, sf):
    return workspace.walked(fixtures.tree(spark)).select("path")


@query(bm25_sql(ASKED, 150, 135) + """ SELECT query_id, path, start, "end", score, rank FROM ranked WHERE rank <= 10 AND regexp_matches(path, '^src1[^/]*/')""")
def hit_filter(spark, sf):
    """Filters on the list that a search gave."""
    return fusion.kept_hits(_bm25(spark, sf, benchmark_queries(spark, sf)), globs=["src1*/**"])


@query(
    bm25_sql("asked AS (SELECT 0::BIGINT AS query_id, unnest(['gnu', 'license', 'public']) AS term)", 150, 135)
    + """ SELECT query_id, string_agg(path || ':' || start || '-' || "end" || ' [lines ' || start || '-' || "end" || '] (' || printf('%.3f', score) || ') source=bm25', chr(10) ORDER BY rank) AS text FROM ranked WHERE rank <= 5 GROUP BY query_id
    UNION ALL SELECT 1, '0 hits'"""
)
def result_text(spark, sf):
    queries = spark.createDataFrame([(0, "GNU public-license"), (1, "")], "query_id long, query string")
    hits = lexical.search(chunking.windows(files(spark, sf)), queries, 5, fields=("text",)).withColumn("source", F.lit("bm25"))
    return sinks.as_text(queries.select("query_id").join(hits, "query_id", "left"))


@query("SELECT doc_id, coalesce(trim(list_filter(string_split_regex(text, '\\r?\\n'), lambda x: trim(x) <> '')[1]), '') AS line FROM documents")
def first_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sinks.first_line("text").alias("line"))


@query("SELECT item_id, 'query: ' || text || ' gnu foo::Bar' AS query FROM benchmark")
def anchored_queries(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", sinks.asked("text", ["gnu", "foo::Bar"], "query: ").alias("query"))


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN row_number() OVER (ORDER BY doc_id::VARCHAR) % 2 = 1 THEN 'dev' ELSE 'held' END AS part FROM labels")
def eval_split(spark, sf):
    return evaluation.split(_outcomes(spark, sf)).select("id", "part")


@query("WITH b AS (SELECT user_id, event_type, min(value) AS ms, max(event_id % 2 = 0) AS found FROM events GROUP BY ALL) SELECT event_type AS level, count(*) AS queries, round(avg(ms), 6) AS mean_ms, round(avg(found::INT), 6) AS hit_rate FROM b GROUP BY event_type")
def best_of_runs(spark, sf):
    runs = table(spark, sf, "events").select(F.col("user_id").alias("label"), F.col("event_type").alias("level"), F.col("value").alias("ms"), (F.col("event_id") % 2 == 0).alias("found"))
    return evaluation.best_of(runs)


@query(
    """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 3 = 0), r AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 3 <> 0),
    n AS (SELECT l.event_id, l.ts, min({'ts': r.ts, 'path': r.event_id::VARCHAR}) AS next FROM l LEFT JOIN r ON l.user_id = r.user_id AND r.ts >= l.ts GROUP BY l.event_id, l.ts)
    SELECT event_id::VARCHAR AS query, CASE WHEN next.ts <= ts + INTERVAL 6 HOUR THEN next.path END AS path FROM n"""
)
def asof_next_read(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("root"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("name"), "event_id")
    log = e.where("event_id % 3 = 0").select("root", "ts", F.col("name").alias("query"))
    reads = e.where("event_id % 3 <> 0").select("root", "ts", F.col("name").alias("path"))
    return evaluation.next_read(log, reads, "6 HOURS").select("query", "path")


@query(
    """WITH c AS (SELECT count(*) AS chunks, count(*) FILTER (doc_id % 4 <> 0 AND (doc_id % 10 <> 1 OR text = 'old')) AS kept FROM documents WHERE doc_id % 3 <> 0), g AS (SELECT count(*) AS to_drop FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 3 = 0)
    SELECT chunks, chunks - kept AS to_embed, to_drop, kept FROM c, g"""
)
def embed_counters(spark, sf):
    return vectors.counters(*_stores(spark, sf))


@query(_golden_chunks([]).replace("VALUES ", "SELECT NULL, NULL, NULL, NULL, NULL WHERE FALSE") + " UNION ALL SELECT source, doc_id, doc_id, 'reset', lang FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 9 = 0")
def store_of_model(spark, sf):
    """A store of the same model is gone on from; one of another model is empty."""
    _, store = _stores(spark, sf)
    same = vectors.usable_store(store, "m", 2, "m", 2).unionByName(vectors.usable_store(store, "m", 2, "n", 2))
    return same.where("start % 9 = 0").select(F.col("rel").alias("path"), "start", "end", F.lit("reset").alias("kind"), "breadcrumb")

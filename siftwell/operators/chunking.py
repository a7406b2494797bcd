"""Chunk extraction: line windows, markdown sections, header comments, symbols and calls."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.operators import braces
from siftwell.operators.braces import CHUNK
from siftwell.operators.lines import line_array

LEXICAL_WINDOW, VECTOR_WINDOW = (150, 135), (50, 40)
SYMBOL_LINES, SYMBOL_STEP, HEADER_LINES = 80, 65, 30
HEADER_MARKS = {"rs": "//", "ts": "//", "tsx": "//", "js": "//", "jsx": "//", "go": "//", "java": "//", "py": "#", "nix": "#", "sh": "#"}


def window_starts(n: Column, size: int, step: int) -> Column:
    """0-based first lines of the windows over n lines; none goes on after one that reached the end."""
    count = F.when(n <= size, F.lit(1)).otherwise(1 + F.ceil((n - size) / F.lit(float(step))).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: k * step)).otherwise(F.array().cast("array<int>"))


def windows(files: DataFrame, size: int = LEXICAL_WINDOW[0], step: int = LEXICAL_WINDOW[1]) -> DataFrame:
    """Fixed line windows of every file."""
    df = files.select("path", line_array("content").alias("l"))
    df = df.select("path", "l", F.explode(window_starts(F.size("l"), size, step)).alias("s"))
    end = F.least(F.col("s") + size, F.size("l"))
    return df.select(
        "path",
        (F.col("s") + 1).cast("long").alias("start"),
        end.cast("long").alias("end"),
        F.lit("window").alias("kind"),
        F.format_string("lines %d-%d", F.col("s") + 1, end).alias("breadcrumb"),
        F.concat_ws("\n", F.slice("l", F.col("s") + 1, size)).alias("text"),
    )


def sections(files: DataFrame, nested_fix: bool = False) -> DataFrame:
    """Markdown sections: a heading up to the next of its level or above; text before the first is `(preamble)`."""
    df = files.select("path", line_array("content").alias("l"))
    head = r"^\s*(#{1,6}) (.*)$"
    found = F.filter(F.transform("l", lambda x, i: F.struct((i + 1).alias("at"), F.length(F.regexp_extract(x, head, 1)).alias("level"), F.trim(F.regexp_extract(x, head, 2)).alias("title"))), lambda h: h["level"] > 0)
    df = df.withColumn("heads", found)
    plain = windows(files.join(df.where(F.size("heads") == 0).select("path"), "path", "left_semi"))
    df = df.where(F.size("heads") > 0)
    after = lambda h: F.array_min(F.transform(F.filter("heads", lambda o: (o["at"] > h["at"]) & (o["level"] <= h["level"])), lambda o: o["at"]))
    rows = df.select("path", "l", "heads", F.explode("heads").alias("h"), F.size("l").alias("n"))
    rows = rows.withColumn("stop", F.coalesce(after(F.col("h")) - 1, F.col("n")))
    if nested_fix:
        # ancestors: earlier headings of a lower level that no heading of their level or above closes before this one
        above = F.filter("heads", lambda o: (o["at"] < F.col("h.at")) & (o["level"] < F.col("h.level")) & ~F.exists("heads", lambda m: (m["at"] > o["at"]) & (m["at"] < F.col("h.at")) & (m["level"] <= o["level"])))
        crumb = F.concat_ws(" > ", F.transform(above, lambda o: o["title"]), F.col("h.title"))
    else:  # a stack cut to one less than each heading's level, whatever levels it holds
        so_far = F.filter("heads", lambda o: o["at"] <= F.col("h.at"))
        stack = F.aggregate(so_far, F.array().cast("array<string>"), lambda a, o: F.concat(F.slice(a, F.lit(1), F.least(F.size(a), o["level"] - 1)), F.array(o["title"])))
        crumb = F.array_join(stack, " > ")
    out = rows.select("path", F.col("h.at").cast("long").alias("start"), F.col("stop").cast("long").alias("end"), F.lit("section").alias("kind"), crumb.alias("breadcrumb"), F.concat_ws("\n", F.slice("l", F.col("h.at"), F.col("stop") - F.col("h.at") + 1)).alias("text"))
    first = F.element_at("heads", 1)["at"]
    lead = F.slice("l", F.lit(1), first - 1)
    pre = df.where((first > 1) & F.exists(lead, lambda x: F.trim(x) != "")).select("path", F.lit(1).cast("long").alias("start"), (first - 1).cast("long").alias("end"), F.lit("section").alias("kind"), F.lit("(preamble)").alias("breadcrumb"), F.concat_ws("\n", lead).alias("text"))
    return out.unionByName(pre).unionByName(plain)


def headers(files: DataFrame) -> DataFrame:
    """The block of comment lines that opens a source file, at most HEADER_LINES long."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    marks = F.create_map(*[F.lit(x) for kv in HEADER_MARKS.items() for x in kv])
    df = files.select("path", line_array("content").alias("l"), F.element_at(marks, ext).alias("mark")).where("mark is not null")
    first = F.struct(F.lit(0).alias("from"), F.lit(0).alias("to"), F.lit(False).alias("over"))

    def step(a, i):
        x = F.trim(F.element_at("l", i))
        skip = ((x == "") & (a["from"] == 0)) | x.startswith("#!")
        mine = x.startswith(F.col("mark")) & ~a["over"] & ~skip & ((a["from"] == 0) | (i - a["from"] < HEADER_LINES))
        return F.struct(F.when(mine & (a["from"] == 0), i).otherwise(a["from"]).alias("from"), F.when(mine, i).otherwise(a["to"]).alias("to"), (a["over"] | (~mine & ~skip)).alias("over"))

    at = F.aggregate(F.sequence(F.lit(1), F.size("l")), first, step)
    df = df.where(F.size("l") > 0).withColumn("at", at).where("at.from > 0")
    return df.select("path", F.col("at.from").cast("long").alias("start"), F.col("at.to").cast("long").alias("end"), F.lit("section").alias("kind"), F.lit("(header)").alias("breadcrumb"), F.concat_ws("\n", F.slice("l", F.col("at.from"), F.col("at.to") - F.col("at.from") + 1)).alias("text"))


def _defined(tree: ast.AST) -> Iterator[tuple[str, int, int]]:
    def walk(node: ast.AST, outer: tuple[str, ...]) -> Iterator[tuple[str, int, int]]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                crumb = (*outer, child.name)
                yield " > ".join(crumb), child.lineno, child.end_lineno
                yield from walk(child, crumb)
            else:
                yield from walk(child, outer)

    return walk(tree, ())


def python_symbols(files: DataFrame) -> DataFrame:
    """Functions and classes of Python files; nested ones are chunks of their own. Files that don't parse give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError):
                    continue
                l = content.split("\n")
                rows += [(path, a, b, "symbol", crumb, "\n".join(l[a - 1 : b])) for crumb, a, b in _defined(tree)]
            yield pd.DataFrame(rows, columns=["path", "start", "end", "kind", "breadcrumb", "text"])

    return files.where(F.col("path").endswith(".py")).select("path", "content").mapInPandas(run, CHUNK)


def code_symbols(files: DataFrame) -> DataFrame:
    """Symbols of all languages that have an extractor."""
    return python_symbols(files).unionByName(braces.symbols(files))


def code_calls(files: DataFrame) -> DataFrame:
    """path, caller, callee of calls in Python and Rust files."""
    return python_calls(files).unionByName(braces.rust_calls(files))


def split_oversized(chunks: DataFrame) -> DataFrame:
    """Symbols of more than SYMBOL_LINES + 1 lines become overlapping parts marked ` [i/n]`."""
    span = F.col("end") - F.col("start") + 1
    long = (F.col("kind") == "symbol") & (F.col("end") > F.col("start") + SYMBOL_LINES)
    n = F.when(long, F.ceil((span - SYMBOL_LINES) / F.lit(float(SYMBOL_STEP))).cast("int") + 1).otherwise(1)
    df = chunks.withColumn("long", long).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    start = F.col("start") + F.col("k") * SYMBOL_STEP
    end = F.least(start + SYMBOL_LINES - 1, F.col("end"))
    text = F.concat_ws("\n", F.slice(F.split("text", "\n"), F.col("k") * SYMBOL_STEP + 1, SYMBOL_LINES))
    pick = lambda a, b: F.when(F.col("long"), a).otherwise(b)
    return df.select("path", pick(start, F.col("start")).alias("start"), pick(end, F.col("end")).alias("end"), "kind", pick(F.concat("breadcrumb", F.format_string(" [%d/%d]", F.col("k") + 1, F.col("n"))), F.col("breadcrumb")).alias("breadcrumb"), pick(text, F.col("text")).alias("text"))


def extract(files: DataFrame, size: int = LEXICAL_WINDOW[0], step: int = LEXICAL_WINDOW[1]) -> DataFrame:
    """All chunks of readable files, by extension."""
    md = F.lower("path").rlike(r"\.(md|markdown)$")
    symbols = code_symbols(files)
    rest = files.where(~md).join(symbols.select("path").distinct(), "path", "left_anti")
    return split_oversized(symbols).unionByName(sections(files.where(md))).unionByName(windows(rest, size, step)).unionByName(headers(files))


def enclosing(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """The tightest chunk around each point(path, line)."""
    c = chunks.select("path", "start", "end", "kind", "breadcrumb")
    met = points.join(c, "path").where("start <= line AND line <= end")
    w = W.partitionBy("path", "line").orderBy(F.col("end") - F.col("start"), "start", "breadcrumb")
    return met.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def python_calls(files: DataFrame) -> DataFrame:
    """path, caller (crumb of the innermost symbol), callee of calls in Python files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError):
                    continue
                spans = list(_defined(tree))
                for node in ast.walk(tree):
                    if isinstance(node, ast.Call):
                        f = node.func
                        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                        inside = [s for s in spans if s[1] <= node.lineno <= s[2]]
                        if name and inside:
                            rows.append((path, min(inside, key=lambda s: s[2] - s[1])[0], name))
            yield pd.DataFrame(rows, columns=["path", "caller", "callee"])

    return files.where(F.col("path").endswith(".py")).select("path", "content").mapInPandas(run, "path string, caller string, callee string")

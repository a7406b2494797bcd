"""Files as tables: a folder tree through Spark's readers, or a table of documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import glob_regex

FILE_CAP = 5 * 1024 * 1024
LINE_CAP = 8192
EXTRACT_VERSION = "3"
# What an index leaves out.
SKIP_FILES = ["Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "flake.lock", "Gemfile.lock", "poetry.lock"]
SKIP_DIRS = ["target", "node_modules", "dist", "build", ".git"]
SKIP_EXTENSIONS = "gguf jsonl safetensors onnx pt bin pyc png jpg jpeg gif pdf zip tar gz".split()
WATCH_SKIP = [".git", "target", "node_modules", ".siftwell"]


def documents_as_files(docs: DataFrame) -> DataFrame:
    """path, content: documents in the role of files."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(path.alias("path"), F.col("text").alias("content"))


def scan(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """path (relative), mtime, len and, unless pruned, content of all files under a root, or of one file."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^(file:/*)?/*", "", root.rstrip("/"))
    full = F.regexp_replace("path", r"^[a-z0-9]+:/+", "")
    relative = F.when(full == base, F.element_at(F.split(full, "/"), -1)).otherwise(F.substring(full, F.lit(len(base) + 2), F.length(full)))
    out = raw.select(relative.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("len"), *(["content"] if content else []))
    return out


def hidden(path: Column | str) -> Column:
    return F.exists(F.split(path, "/"), lambda x: x.startswith("."))


def indexable(path: Column | str) -> Column:
    """Whether an index takes a path: no skipped name or folder on it, and no skipped extension."""
    names = F.exists(F.split(path, "/"), lambda x: x.isin(SKIP_FILES + SKIP_DIRS))
    return ~hidden(path) & ~names & ~F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(SKIP_EXTENSIONS)


def watch_relevant(path: Column | str) -> Column:
    return ~F.exists(F.split(path, "/"), lambda x: x.isin(WATCH_SKIP))


def ignored(path: Column | str, rules: list[str]) -> Column:
    """Ignore-file rules: `#` comments, `!` takes back, a leading slash anchors, the last match decides."""
    out = F.lit(False)
    for rule in rules:
        rule = rule.rstrip()
        if rule and not rule.startswith("#"):
            out = F.when(F.col(path).rlike(glob_regex(rule.lstrip("!"))) if isinstance(path, str) else path.rlike(glob_regex(rule.lstrip("!"))), F.lit(not rule.startswith("!"))).otherwise(out)
    return out


def readable(files: DataFrame) -> DataFrame:
    """Files that are chunked: within the size cap, no NUL byte, no overlong line; content as text."""
    df = files.where("len <= %d" % FILE_CAP) if "len" in files.columns else files
    text = F.make_valid_utf8(F.col("content").cast("string")) if dict(df.dtypes)["content"] == "binary" else F.col("content")
    df = df.withColumn("content", text)
    return df.where(~accepted_content("content", False))


def accepted_content(content: Column | str, ok: bool = True) -> Column:
    """Whether content has no NUL and no line over the cap (or, if not ok, the opposite)."""
    c = F.col(content) if isinstance(content, str) else content
    bad = F.contains(c, F.lit("\0")) | F.exists(F.split(c, "\n"), lambda x: F.octet_length(x) > LINE_CAP)
    return ~bad if ok else bad


def until_nul(content: Column | str) -> Column:
    """What a live search sees of a file."""
    return F.substring_index(content, "\0", 1)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, empty where none was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


MANIFEST = "path string, mtime timestamp, len long"


def read_manifest(spark: SparkSession, path: str, version: str = EXTRACT_VERSION) -> DataFrame:
    """The manifest of an extractor version; of another version none, so all is extracted anew."""
    return read_table(spark, f"{path}/version={version}", MANIFEST)


def write_manifest(files: DataFrame, path: str, version: str = EXTRACT_VERSION) -> None:
    files.select("path", "mtime", "len").write.mode("overwrite").parquet(f"{path}/version={version}")


def contained(path: str) -> str:
    """A relative path in normal form; one that leaves the root is refused."""
    import posixpath

    out = posixpath.normpath(path)
    if out.startswith(("..", "/")):
        raise ValueError(f"outside of the root: {path}")
    return out


IGNORE_FILES = (".gitignore", ".ignore")


def _rules(content: str | None) -> list[tuple[int, str, bool]]:
    """(line, regular expression, takes back) of each rule of an ignore file, relative to its folder."""
    out = []
    for k, line in enumerate((content or "").splitlines()):
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        back = rule.startswith("!")
        rule = rule[1:] if back else rule
        folder = rule.endswith("/")
        anchored = "/" in rule.rstrip("/")
        body = glob_regex(rule.strip("/")).removeprefix("^").removeprefix("(?:.*/)?").removesuffix("$")
        out.append((k, ("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if folder else "(?:/.*)?$"), back))
    return out


def walked(files: DataFrame) -> DataFrame:
    """The files(path, content) that a walk gives: no hidden ones, and none that the ignore files on its way rule out.

    Rules of a deeper ignore file come after those of its parents, and the last rule that matches
    decides. Ignore files are rows of the scan like any others; they meet paths in a join by folder.
    """
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    rules = F.udf(_rules, "array<struct<line: int, pattern: string, back: boolean>>")
    given = files.where(name.isin(*IGNORE_FILES)).select(folder.alias("folder"), name.alias("file"), F.explode(rules(F.col("content").cast("string"))).alias("rule"))
    seen = files.where(~hidden("path"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))
    met = seen.select("path", F.explode(above).alias("folder")).join(given, "folder")
    rest = F.expr("substring(path, length(folder) + 1)")
    hit = met.where(F.regexp_like(rest, F.col("rule.pattern")))
    last = hit.groupBy("path").agg(F.max_by("rule.back", F.struct(F.length("folder"), "file", "rule.line")).alias("back"))
    return seen.join(last.where("not back").select("path"), "path", "left_anti")


def valid_root(root: str, file_too: bool = False) -> str:
    """A root as it may be searched: an absolute path of a folder (or, for a live search, of a file)."""
    from pathlib import Path

    p = Path(root)
    if not p.is_absolute() or not (p.is_dir() or file_too and p.is_file()):
        raise ValueError(f"not an absolute folder{' or file' if file_too else ''}: {root}")
    return str(p)


def scratch(spark: SparkSession, name: str) -> str:
    """A new place for a stored table in the shared folder of the session; a local one only in a local session that names none."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or '/tmp/checkpoints').rstrip('/')}/siftwell/{name}-{uuid.uuid4().hex}"


def assignments(text: str) -> dict[str, str]:
    """NAME=value lines, with or without `export` and quotes; the last of a name wins."""
    out = {}
    for line in text.splitlines():
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$", line)
        if m:
            value = m[2]
            out[m[1]] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def setting(name: str, environment: dict[str, str], files: list[str] = ()) -> str | None:
    """A setting from the environment, else from the first of the texts of assignments that has it."""
    if environment.get(name):
        return environment[name]
    return next((found for text in files if (found := assignments(text).get(name))), None)

"""Skill files: front matter and ranking by shared words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import cut_bytes, skill_tokens, token_overlap

DESCRIPTION_BYTES, READ_BYTES, FLOOR = 200, 65536, 0.2


def front_matter(text: str) -> dict[str, str]:
    """Scalars of the block between `---` lines: plain, quoted, folded (>) and literal (|) values. Not YAML at large."""
    lines = text.removeprefix("﻿").replace("\r\n", "\n").split("\n")
    if not lines or lines[0].strip() != "---":
        raise ValueError("no front matter")
    try:
        end = next(i for i in range(1, len(lines)) if lines[i].strip() == "---")
    except StopIteration:
        raise ValueError("front matter has no end") from None
    out, i = {}, 1
    while i < end:
        m = re.match(r"([A-Za-z_][\w-]*):\s*(.*)$", lines[i])
        i += 1
        if not m:
            continue
        value = m[2].strip()
        if re.fullmatch(r"[>|][+-]?", value):
            block = []
            while i < end and (not lines[i].strip() or lines[i][0] in " \t"):
                block.append(lines[i].strip())
                i += 1
            while block and not block[-1]:
                block.pop()
            value = "\n".join(block) if m and value[0] == "|" else re.sub(r" ?\n ?", "\n", " ".join(x or "\n" for x in block))
        elif len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out[m[1]] = value
    return out


def parsed(skills: DataFrame) -> DataFrame:
    """folder, name, description, error of skills(folder, content)."""

    @F.pandas_udf("name string, description string, error string")
    def parse(content):
        import pandas as pd

        rows = []
        for c in content:
            try:
                m = front_matter((c or "")[:READ_BYTES])
                rows.append((m.get("name"), m.get("description"), None if m.get("description") else "no description"))
            except ValueError as e:
                rows.append((None, None, str(e)))
        return pd.DataFrame(rows, columns=["name", "description", "error"])

    df = skills.withColumn("m", parse("content"))
    return df.select("folder", F.coalesce("m.name", "folder").alias("name"), cut_bytes("m.description", DESCRIPTION_BYTES, "…").alias("description"), "m.error").orderBy("folder")


def ranked(entries: DataFrame, query: str, limit: int = 2) -> DataFrame:
    """Skills by the share of the query's words in name and description."""
    score = token_overlap(skill_tokens(F.lit(query)), skill_tokens(F.concat_ws(" ", "name", "description")))
    return entries.where("error is null").withColumn("score", F.round(score, 6)).where(F.col("score") >= FLOOR).orderBy(F.desc("score"), "name").limit(max(1, min(limit, 5)))


def library(files: DataFrame) -> DataFrame:
    """folder, content of the skill files of a scan: <folder>/SKILL.md, one level below the root."""
    folder = F.regexp_extract("path", r"^([^/]+)/SKILL\.md$", 1)
    return files.select(folder.alias("folder"), F.col("content").cast("string").alias("content")).where("folder <> ''")


def judged(entries: DataFrame, answers: DataFrame, limit: int = 2, exists_floor: float = 0.5, score_floor: float = 0.5) -> DataFrame:
    """Skills by a judge's answers(name, exists, score): those it finds fit at all, and well enough."""
    met = entries.where("error is null").join(answers, "name")
    fit = met.where((F.col("exists") >= exists_floor) & (F.col("score") >= score_floor))
    return fit.drop("exists").orderBy(F.desc("score"), "name").limit(max(1, min(limit, 5)))

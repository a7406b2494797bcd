"""Symbols of Rust, JavaScript, TypeScript, Go and Java files, and calls of Rust files.

A scanner, not a parser: comments and literals are blanked, declarations are found at line starts,
and their ends by matching brackets. A file whose brackets don't match gives nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTENSIONS = {"rs": "rust", "ts": "js", "mts": "js", "cts": "js", "tsx": "js", "jsx": "js", "js": "js", "mjs": "js", "cjs": "js", "go": "go", "java": "java"}
CHUNK = "path string, start long, end long, kind string, breadcrumb string, text string"

_COMMENT, _DOUBLE, _SINGLE = r"//[^\n]*|/\*.*?\*/", r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\\n])*'"
LITERALS = {
    "rust": re.compile(rf"{_COMMENT}|b?r(#*)\".*?\"\1|b?{_DOUBLE}|b?'(?:\\[^\n]{{1,10}}?|[^'\\\n])'", re.S),
    "js": re.compile(rf"{_COMMENT}|{_DOUBLE}|{_SINGLE}|`(?:\\.|[^`\\])*`", re.S),
    "go": re.compile(rf"{_COMMENT}|{_DOUBLE}|{_SINGLE}|`[^`]*`", re.S),
    "java": re.compile(rf'{_COMMENT}|""".*?"""|{_DOUBLE}|{_SINGLE}', re.S),
}
_JAVA_LEAD = r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|static|final|abstract|sealed|synchronized|native|default|strictfp)\s+)*"
_JAVA_NOT_TYPE = r"(?!(?:return|new|else|throw|case|public|protected|private|static|final|abstract|synchronized|native|default|record)\b)"
#: Group `name`, and `what`: the keyword that decides how a declaration ends.
DECLARED = {
    "rust": re.compile(r"^[ \t]*(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|unsafe|async|const|extern)\s+)*?(?:(?P<what>fn|struct|enum|union|trait|mod|type|const|static(?:\s+mut)?|macro_rules!)\s+(?!(?:fn|unsafe|async|extern)\b)(?P<name>[A-Za-z_]\w*)|impl\b(?P<impl>[^{;]*))", re.M),
    "js": re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:const\s+(?=enum\b))?(?:(?P<what>function|class|interface|enum)\b\s*\*?\s*(?P<name>[\w$]+)|type\s+(?P<alias>[\w$]+)\s*(?:<[^=;]*>)?\s*=)", re.M),
    "go": re.compile(r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)|^type\s+(?P<alias>\w+)|^type\s*(?P<many>\()", re.M),
    "java": re.compile(rf"{_JAVA_LEAD}(?:(?P<what>class|interface|enum|@interface)\s+(?P<name>\w+)|(?:<[^;{{}}()]*>\s*)?{_JAVA_NOT_TYPE}[\w.$]+(?:<[^;{{}}()]*>)?(?:\[\])*\s+(?P<method>\w+)\s*(?=\())", re.M),
}
_CALL = re.compile(r"(?<![\w!])([A-Za-z_]\w*)\s*(?:::<[^()]*?>)?\s*\(")
_NOT_CALLED = {"if", "while", "for", "match", "return", "in", "loop", "fn", "let", "move", "where", "as", "else", "impl", "pub"}
_PAIRS = {")": "(", "]": "[", "}": "{"}


def blanked(text: str, language: str) -> str:
    """The text with comments and literals as spaces; lines and offsets stay."""
    return LITERALS[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closings(code: str) -> dict[int, int] | None:
    """Where each bracket closes; None if some don't match."""
    held: list[int] = []
    out = {}
    for m in re.finditer(r"[()\[\]{}]", code):
        c = m[0]
        if c in "([{":
            held.append(m.start())
        elif not held or code[held[-1]] != _PAIRS[c]:
            return None
        else:
            out[held.pop()] = m.start()
    return None if held else out


def _end(code: str, at: int, close: dict[int, int], stops: str, body: bool) -> tuple[int, str]:
    """The offset where a declaration ends and the character that ends it: a stop outside brackets, or its body's brace."""
    while at < len(code):
        c = code[at]
        if at in close:
            if body and c == "{":
                return close[at], "}"
            at = close[at]
        elif c in stops:
            joined = c == "\n" and (code[:at].rstrip()[-1:] in ("=", "|", "&") or code[at:].lstrip()[:1] in ("|", "&"))
            if not joined:
                return at, c
        elif c in ")]}":
            return at - 1, c
        at += 1
    return len(code) - 1, ""


def _target(head: str) -> str:
    """`impl T` of an impl's head: generics of the impl and the trait are left out."""
    head = head.split(" where ")[0].strip()
    if head.startswith("<"):
        depth = 0
        for i, c in enumerate(head):
            depth += (c == "<") - (c == ">" and head[i - 1] != "-")
            if not depth:
                head = head[i + 1 :]
                break
    return "impl " + " ".join(re.split(r"\bfor\b(?!\s*<)", head)[-1].split())


def declarations(text: str, language: str) -> list[tuple[str, int, int]]:
    """(breadcrumb, first line, last line) of every declaration, outer ones first."""
    code = blanked(text, language)
    close = closings(code)
    if close is None:
        return []
    found = []
    for m in DECLARED[language].finditer(code):
        g, start = m.groupdict(), m.end() - len(m[0].lstrip())
        if g.get("many"):
            at, stop = m.end(), close[m.end() - 1]
            while spec := re.compile(r"\s*(\w+)").match(code, at, stop):
                at = _end(code, spec.end(), close, "\n", False)[0]
                found.append((spec.start(1), at, spec[1]))
            continue
        name = g.get("name") or g.get("alias") or g.get("method") or _target(g["impl"])
        if language == "go":
            end, by = _end(code, m.end(), close, "\n", False)
        elif g.get("alias"):
            end, by = _end(code, m.end(), close, ";\n", False)
        else:
            end, by = _end(code, m.end(), close, ";", (g.get("what") or "fn").split()[0] not in ("const", "static", "type"))
        signature = by == ";" and (language, g.get("what")) in (("rust", "fn"), ("js", "function"))
        bare = g.get("what") == "type" and "=" not in code[m.end() : end]
        if not signature and not bare and by in ("}", ";", "\n", ""):
            found.append((start, end, name))
    out, scope = [], []
    lines = [i for i, c in enumerate(code) if c == "\n"]
    line = lambda at: 1 + pd.Index(lines).searchsorted(at) if lines else 1
    for start, end, name in sorted(found, key=lambda f: (f[0], -f[1])):
        while scope and scope[-1][0] < start:
            scope.pop()
        scope.append((end, name))
        out.append((" > ".join(n for _, n in scope), int(line(start)), int(line(end))))
    return out


def _files(files: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    wanted = [e for e, n in EXTENSIONS.items() if n in languages]
    return files.select("path", "content", F.regexp_extract("path", r"\.([^./]+)$", 1).alias("ext")).where(F.col("ext").isin(wanted))


def symbols(files: DataFrame) -> DataFrame:
    """Declarations of brace-language files as chunks; nested ones are chunks of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content, ext in pdf.itertuples(index=False):
                l = (content or "").split("\n")
                rows += [(path, a, b, "symbol", crumb, "\n".join(l[a - 1 : b])) for crumb, a, b in declarations(content or "", EXTENSIONS[ext])]
            yield pd.DataFrame(rows, columns=["path", "start", "end", "kind", "breadcrumb", "text"])

    return _files(files, ("rust", "js", "go", "java")).mapInPandas(run, CHUNK)


def rust_calls(files: DataFrame) -> DataFrame:
    """path, caller (crumb of the innermost symbol), callee of calls in Rust files; macros are no calls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content, _ in pdf.itertuples(index=False):
                spans = declarations(content or "", "rust")
                code = re.sub(r"#!?\[[^\]\n]*\]|\b(?:fn|struct|enum|union)\s+\w+", lambda m: " " * len(m[0]), blanked(content or "", "rust"))
                for m in _CALL.finditer(code):
                    at = code.count("\n", 0, m.start()) + 1
                    inside = [s for s in spans if s[1] <= at <= s[2]]
                    if inside and m[1] not in _NOT_CALLED:
                        rows.append((path, min(inside, key=lambda s: s[2] - s[1])[0], m[1]))
            yield pd.DataFrame(rows, columns=["path", "caller", "callee"])

    return _files(files, ("rust",)).select("path", "content", "ext").mapInPandas(run, "path string, caller string, callee string")

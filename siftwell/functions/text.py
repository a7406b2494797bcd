"""Scalar functions of retrieval, as Column builders, with driver-side twins where a plan needs them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a fallback search ignores.
FALLBACK_STOP = (
    "a an and are as at be by can do does for from how i in into is it its of on "
    "or that the this to we what when where which who why with you"
).split()
# Words that skill matching ignores.
SKILL_STOP = (
    "a an the and or for to of in on with is are be this that from as at by it do "
    "does how what when where which who whom into via use using need your you"
).split()
# Names whose assigned values are redacted.
SECRET_NAMES = "api_key apikey auth authorization bearer key passwd password secret token".split()
# File extensions of each language.
LANGUAGES = {
    "rust": ["rs"],
    "python": ["py"],
    "typescript": ["ts", "mts", "cts", "tsx", "jsx", "js", "mjs", "cjs"],
    "go": ["go"],
    "java": ["java"],
    "nix": ["nix"],
    "markdown": ["md", "markdown"],
}
RRF_K, LEXICAL_WEIGHT = 20, 2.0
MAX_TERMS = 8
TERM_BYTES = 40


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- patterns -----------------------------------------------------------------


def normalize_pattern(raw: str) -> str:
    """Trim; take off one outer pair of equal quotes, unless that leaves a blank or the quote stands inside; idempotent."""
    s = raw.strip()
    if len(s) >= 2 and s[0] == s[-1] and s[0] in "\"'" and s[1:-1].strip() and s[0] not in s[1:-1]:
        return s[1:-1]
    return s


def quoted(literal: str) -> str:
    """A literal as a regular expression of Java's dialect, alone or inside a larger one."""
    return re.sub(r"([\\.+*?()|\[\]{}^$#&\-~])", r"\\\1", literal)


def line_matches(text: Column | str, pattern: str, regex: bool = False, ignore_case: bool = False) -> Column:
    """Whether a line holds the pattern: a literal unless `regex`. An invalid or back-referring pattern is refused."""
    if not regex and not ignore_case:
        return _c(text).contains(pattern)
    if regex:
        if re.search(r"\\[1-9]|\(\?[=!<]", pattern):
            raise ValueError("back-references and look-around are not supported")
        re.compile(pattern)
    return _c(text).rlike(("(?iu)" if ignore_case else "") + (pattern if regex else quoted(pattern)))


def extensions_of(langs: list[str]) -> list[str]:
    """Extensions of language names or plain extensions; an unknown one is an error."""
    out: list[str] = []
    known = {e for es in LANGUAGES.values() for e in es}
    for lang in langs:
        name = lang.strip().lower().lstrip(".")
        if name in LANGUAGES:
            out += LANGUAGES[name]
        elif name in known:
            out.append(name)
        else:
            raise ValueError(f"unknown language: {lang}")
    return list(dict.fromkeys(out))


def in_languages(path: Column | str, langs: list[str]) -> Column:
    """Whether a path's extension belongs to one of the languages; an empty list passes all."""
    if not langs:
        return F.lit(True)
    return F.lower(F.regexp_extract(_c(path), r"\.([^./]+)$", 1)).isin(extensions_of(langs))


def glob_regex(glob: str) -> str:
    """A glob as a regular expression over relative paths. Without a slash it matches at any depth."""
    g = glob.lstrip("/")
    out, i = "", 0
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        elif g[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif g[i] == "?":
            out, i = out + "[^/]", i + 1
        elif g[i] == "{" and "}" in g[i:]:
            j = g.index("}", i)
            out, i = out + "(?:" + "|".join(quoted(p).replace(r"\*", "[^/]*") for p in g[i + 1 : j].split(",")) + ")", j + 1
        else:
            out, i = out + quoted(g[i]), i + 1
    return ("^" if "/" in glob.rstrip("/") else "^(?:.*/)?") + out.rstrip("/") + "(?:/.*)?$"


def keeps_globs(path: Column | str, globs: list[str]) -> Column:
    """Globs with `!` drop; the last glob that matches decides; unmatched paths stay if no glob is positive."""
    keep = F.lit(not any(not g.startswith("!") for g in globs))
    for g in globs:
        keep = F.when(_c(path).rlike(glob_regex(g.lstrip("!"))), F.lit(not g.startswith("!"))).otherwise(keep)
    return keep


# --- queries ------------------------------------------------------------------


def identifier_like(term: Column | str) -> Column:
    return _c(term).rlike(r"[-_/.A-Z]")


def fallback_terms(query: Column | str) -> Column:
    """Up to eight search terms of a query: longest first, identifiers alone if there are any."""
    parts = F.split(_c(query), r"[^A-Za-z0-9\-_./]+")
    parts = F.filter(parts, lambda t: (F.octet_length(t) >= 2) & ~F.lower(t).isin(FALLBACK_STOP))
    keyed = F.array_sort(F.transform(parts, lambda t: F.struct((-F.octet_length(t)).alias("n"), t.alias("t"))))
    terms = F.transform(keyed, lambda x: x["t"])
    terms = F.filter(terms, lambda t, i: (i == 0) | (F.lower(t) != F.lower(F.get(terms, i - 1))))
    named = F.filter(terms, identifier_like)
    return F.slice(F.when(F.size(named) > 0, named).otherwise(terms), 1, MAX_TERMS)


def route(query: Column | str, anchored: Column | None = None) -> Column:
    """Which search answers a query: literal, identifier or intent."""
    q = F.regexp_replace(_c(query), r"(?U)^\s+|\s+$", "")
    quotes = q.rlike(r"""^("[^"]*"|'[^']*')\z""") & q.rlike(r"(?U)^.\s*[^\s\"'][\s\S]*$") & (F.length(q) > 2)
    return (
        F.when(anchored if anchored is not None else F.lit(False), "intent")
        .when(quotes, "literal")
        .when(q.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(::[A-Za-z_][A-Za-z0-9_]*)+\z"), "literal")
        .when(q.rlike(r"^[A-Za-z_][A-Za-z0-9_./-]*\z"), "identifier")
        .otherwise("intent")
    )


def clamp(limit: int, most: int) -> int:
    return max(1, min(limit, most))


# --- tokens -------------------------------------------------------------------


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits of at most TERM_BYTES bytes."""
    return F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) <= TERM_BYTES))


def spaced(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits, of any length, with a space between."""
    return F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}]+", " ")


def skill_tokens(text: Column | str) -> Column:
    parts = F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.octet_length(t) > 1) & ~t.isin(SKILL_STOP)))


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the query's tokens that the text has."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, text)) / F.size(query)).otherwise(0.0)


# --- scores -------------------------------------------------------------------


def rrf(rank: Column | str, weight: float = 1.0) -> Column:
    return F.coalesce(F.lit(weight) / (F.lit(RRF_K) + _c(rank)), F.lit(0.0))


def overlap(a_start, a_end, b_start, b_end) -> Column:
    """Lines that two inclusive ranges share."""
    return F.greatest(F.lit(0), F.least(_c(a_end), _c(b_end)) + 1 - F.greatest(_c(a_start), _c(b_start)))


def source_label(lexical: Column | str, vector: Column | str, structural: Column | str) -> Column:
    lex, vec, ast = (_c(x).isNotNull() for x in (lexical, vector, structural))
    return F.when(ast, "ast").when(lex & vec, "bm25+vec").when(lex, "bm25").when(vec, "vec").otherwise("rg")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision over the shorter length."""
    n = F.least(F.size(_c(a)), F.size(_c(b)))
    pairs = F.zip_with(F.slice(_c(a), F.lit(1), n), F.slice(_c(b), F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column | str) -> Column:
    """A vector of length one; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(_c(v), lambda x: (x / norm).cast("double"))).otherwise(F.transform(_c(v), lambda x: x.cast("double")))


# --- text ---------------------------------------------------------------------


def cut_bytes(text: Column | str, most: int, mark: str = "") -> Column:
    """The longest prefix of whole characters in `most` bytes."""
    c = _c(text)
    raw = F.substring(F.encode(c, "UTF-8"), 1, most)
    clean = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\\x{FFFD}{1,3}$", "")
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(clean, F.lit(mark)))


def collapsed(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def simple_name(crumb: Column | str) -> Column:
    return F.element_at(F.split(_c(crumb), " > "), -1)


def short_name(name: Column | str) -> Column:
    """The first word of a name without a leading `impl` and without a part mark."""
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(_c(name), r" \[\d+/\d+\]$", ""), r"^impl\s+", ""), r"^(\S*)", 1)


def redacted(text: Column | str, strict: bool = False) -> Column:
    """E-mail words and values of secret names are replaced. strict: bearer values and punctuated e-mails too."""
    names = "|".join(SECRET_NAMES)
    out = F.regexp_replace(_c(text), r"(?<!\S)[^\s@]+@[^\s@]+\.[^\s@]+(?!\S)" if not strict else r"[^\s@<>(),;:]+@[^\s@<>(),;:]+\.[A-Za-z0-9]+", "[redacted]")
    if strict:
        out = F.regexp_replace(out, r"(?i)bearer\s+[^\s\"',]+", "Bearer [redacted]")
    return F.regexp_replace(out, rf"(?i)((?:{names})\s*[=:]\s*)(\"[^\"]*\"|'[^']*'|[^\s]+)", "$1[redacted]")


def bearer_hidden(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"Bearer [^\s\"',]+", "Bearer [hidden]")


def utf16_offset(text: Column | str, characters: Column | int) -> Column:
    """UTF-16 code units before a character."""
    n = F.lit(characters) if isinstance(characters, int) else characters
    return (F.octet_length(F.encode(F.substring(_c(text), F.lit(1), n), "UTF-16BE")) / 2).cast("long")

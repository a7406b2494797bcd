"""Small literal workspaces for queries and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AUTH = '''# Token checks for every request.
# Used by the router.

class TokenGuard:
    """Verifies session tokens."""

    def verify(self, token):
        return decode_claims(token) is not None


def decode_claims(token):
    parts = token.split(".")
    return parts if len(parts) == 3 else None
'''
ROUTER = '''from auth import TokenGuard


def dispatch(request):
    guard = TokenGuard()
    if not guard.verify(request):
        return reject(request)
    return handle(request)


def reject(request):
    return 401


def handle(request):
    return 200
'''
SECRETS = """Intro before any heading.

# Secret storage

Where credentials rest at night.

## Rotation

Keys rotate every ninety days.

# Backups

Copies of the vault leave the building weekly.
"""


DOOR = '''pub struct Door { open: bool }

impl Door {
    pub fn knock(&self) -> bool {
        log("knock {");
        answer(self.open)
    }
}

fn answer(open: bool) -> bool { open }
'''
LIFT = '''export class Lift {
  up(floor: number) { return `${floor}}`; }
}

export async function call(lift: Lift) {
  function wait() {}
  return wait();
}

type Floor = "low" | "high";
'''
HALL = """package hall

type (
	Hall struct {
		seats int
	}
)

func (h *Hall) Seats() int {
	return h.seats
}
"""
STAIR = """public class Stair {
  @Override
  public String name(int step) { return "}"; }
  enum Side { LEFT, RIGHT }
}
"""


def building(spark: SparkSession) -> DataFrame:
    """path, content: one source file in each of four languages with braces."""
    return spark.createDataFrame([("src/door.rs", DOOR), ("src/lift.ts", LIFT), ("src/hall.go", HALL), ("src/Stair.java", STAIR)], "path string, content string")


def workspace(spark: SparkSession) -> DataFrame:
    """path, content: two source files and one document."""
    return spark.createDataFrame([("src/auth.py", AUTH), ("src/router.py", ROUTER), ("docs/secrets.md", SECRETS)], "path string, content string")


def cases(spark: SparkSession) -> DataFrame:
    """Labelled queries over the workspace; two have no answer."""
    rows = [
        ("k1", "keyword", "TokenGuard verify", "auth.py"),
        ("k2", "keyword", "dispatch request", "router.py"),
        ("k3", "keyword", "rotation keys", "secrets.md"),
        ("p1", "paraphrase", "where credentials rest", "secrets.md"),
        ("p2", "paraphrase", "reject a request", "router.py"),
        ("s1", "symbol", "decode_claims", "auth.py"),
        ("u1", "unanswerable", "quantum zebra", None),
        ("u2", "unanswerable", "kubernetes ingress", None),
    ]
    return spark.createDataFrame(rows, "id string, kind string, query string, expected string")


def skill_files(spark: SparkSession) -> DataFrame:
    rows = [
        ("notes", "---\nname: release-notes\ndescription: Write release notes from merged changes\n---\nBody"),
        ("folded", "---\nname: review\ndescription: >\n  Review a change\n  for mistakes\n---\n"),
        ("quoted", '---\nname: "deploy"\ndescription: "Ship a build"\n---\n'),
        ("broken", "no front matter"),
        ("empty", "---\nname: empty\n---\n"),
    ]
    return spark.createDataFrame(rows, "folder string, content string")


def length_embedding(texts: list[str]) -> list[list[float]]:
    """A deterministic stand-in for a model: byte length and one."""
    return [[float(len(t.encode("utf-8"))), 1.0] for t in texts]


def tree(spark: SparkSession) -> DataFrame:
    """path, content: a tree with ignore files at two levels."""
    rows = [
        (".gitignore", "# built\n*.log\n/out/\nsecret.txt\n!keep.log\n"),
        ("sub/.gitignore", "!secret.txt\nnotes/*.md\n"),
        ("secret.txt", "x"), ("notes.txt", "x"), ("a/run.log", "x"), ("a/keep.log", "x"), ("out/x.txt", "x"), ("a/out/x.txt", "x"),
        ("sub/secret.txt", "x"), ("sub/notes/a.md", "x"), ("sub/deep/notes/a.md", "x"), (".hidden/a.txt", "x"),
    ]
    return spark.createDataFrame(rows, "path string, content string")


#: Queries and where they go.
ROUTES = [
    ("foo::Bar", "literal"), (" foo::Bar ", "literal"), ('"x:Name"', "literal"), ("'two words'", "literal"), ("'a\"b'", "literal"),
    ("apply_request", "identifier"), ("src/auth.rs", "identifier"), ("one-two", "identifier"), ("_x.y", "identifier"),
    ("where is it handled", "intent"), ("find foo::Bar", "intent"), ("foo::", "intent"), ("::Bar", "intent"), ("foo:::Bar", "intent"),
    ("https://example.com", "intent"), ('""', "intent"), ('"   "', "intent"), ('"foo" OR "bar"', "intent"), ("`foo`", "intent"), ("", "intent"), ("   ", "intent"), ("9lives", "intent"), ('"', "intent"),
]
#: Patterns as they are given and as they are searched.
PATTERNS = [
    ('"foo bar"', "foo bar"), ("'foo bar'", "foo bar"), ('  "foo bar"  ', "foo bar"), ("foo bar", "foo bar"), ('""', '""'), ('"   "', '"   "'),
    ('"foo" OR "bar"', '"foo" OR "bar"'), ("`foo`", "`foo`"), ("", ""), ('" a "', " a "), ('"', '"'), ("\"a'", "\"a'"),
]
HEADINGS = "Before.\n### Deep\nx\n## Less deep\n#\tNo heading\n####### Seven\n# \ny\n### Under it\n"


def values(rows: list[tuple]) -> str:
    """Rows as a SQL VALUES list."""
    show = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)

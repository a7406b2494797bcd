"""The lenient query language of lexical search: any text is a query, and none is an error.

Items are alternatives. Quotes hold a phrase; a word that falls into several terms is one too;
`field:` restricts an item to a field, and an unknown field matches nothing; a leading minus
excludes what the item matches. Quotes and brackets without a partner are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import tokens

ITEM = r"-?(?:[A-Za-z_][A-Za-z0-9_]*:\s*)*(?:\"[^\"]*\"|[^\s\"():]+)"
FIELD = r"^-?([A-Za-z_][A-Za-z0-9_]*):"


def parsed(queries: DataFrame, fields) -> DataFrame:
    """query_id, clause, field, terms, excluded: a row for each item and each field that it is looked for in."""
    items = queries.select("query_id", F.posexplode(F.regexp_extract_all("query", F.lit(ITEM), F.lit(0))).alias("clause", "item"))
    named = F.regexp_extract("item", FIELD, 1)
    value = F.regexp_replace("item", r"^-?(?:[A-Za-z_][A-Za-z0-9_]*:\s*)*", "")
    inside = F.when(named == "", F.array(*[F.lit(f) for f in fields])).otherwise(F.array(named))
    out = items.select("query_id", "clause", F.explode(inside).alias("field"), tokens(value).alias("terms"), F.col("item").startswith("-").alias("excluded"))
    return out.where((F.size("terms") > 0) & F.col("field").isin(*fields))

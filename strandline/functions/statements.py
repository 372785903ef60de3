"""What a stored SQL statement mentions, by text search as in a query history."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words looked for and the names of the findings.
OPERATIONS = ("JOIN", "GROUP BY", "ORDER BY", "WHERE")
STAR_RULE = "avoid-select-star-without-limit"
JOIN_RULE = "join-missing-on"


def referenced_tables(sql_text: Column) -> Column:
    """Names after FROM and JOIN, ``unknown_table`` when there are none."""
    names = F.regexp_extract_all(sql_text, F.lit(r"(?i)(?:FROM|JOIN)\s+([a-zA-Z0-9_.]+)"), F.lit(1))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("unknown_table")))


def lint_flags(sql_text: Column) -> Column:
    """Rules a statement breaks."""
    up = F.upper(sql_text)
    star = up.contains("SELECT *") & ~up.contains("LIMIT")
    bare_join = up.contains("JOIN") & ~up.contains(" ON ") & ~up.contains(" USING ")
    return F.array_compact(F.array(F.when(star, F.lit(STAR_RULE)), F.when(bare_join, F.lit(JOIN_RULE))))


def lint_score(flags: Column) -> Column:
    """1 without findings, else twice their number and one, at most 10."""
    return F.when(F.size(flags) == 0, F.lit(1)).otherwise(F.least(F.lit(10), F.size(flags) * 2 + 1))


def lint_level(score: Column) -> Column:
    return F.when(score <= 2, F.lit("low")).when(score <= 5, F.lit("medium")).otherwise(F.lit("high"))


def query_operations(sql_text: Column) -> Column:
    """Operations named in the text, ``SCAN`` when there are none."""
    up = F.upper(sql_text)
    found = F.array_compact(F.array(*[F.when(up.contains(word), F.lit(word)) for word in OPERATIONS]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("SCAN")))

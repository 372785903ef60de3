"""Names, principals, patterns, labels and statuses as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Consumer groups that are never carried over.
EXCLUDED_GROUPS = "^(connect-.*|schema-registry-.*|console-consumer-.*|kafka-exporter-.*|__.*)$"

# Change-log event types that are applied.
HANDLED_EVENTS = (
    "ADD_PARTITION",
    "ALTER_PARTITION",
    "CREATE_TABLE",
    "ALTER_TABLE",
    "DROP_TABLE",
    "DROP_PARTITION",
    "INSERT",
)

def norm_id(c: Column) -> Column:
    """Identifier for comparison: lower case, without ``-`` and ``_``."""
    return F.lower(F.translate(c, "-_", ""))


def local_part(c: Column) -> Column:
    """Part of a principal before ``@``, in lower case; all of it with no or a leading ``@``."""
    return F.lower(F.when(F.locate("@", c) > 1, F.substring_index(c, "@", 1)).otherwise(c))


def norm_type(c: Column) -> Column:
    """Column type text for comparison: no white space, lower case, NULL as empty."""
    return F.coalesce(F.lower(F.regexp_replace(c, r"\s+", "")), F.lit(""))


def bounded_label(c: Column, known: Sequence[str]) -> Column:
    """A label out of a known set, ``unknown`` when missing, ``other`` otherwise."""
    value = F.lower(F.trim(c))
    return (
        F.when(c.isNull() | (F.trim(c) == ""), F.lit("unknown"))
        .when(value.isin(*[k.lower() for k in known]), value)
        .otherwise(F.lit("other"))
    )


def _usable(pattern: str) -> bool:
    """Whether the engine that will run the pattern accepts it, found out by running it once."""
    spark = SparkSession.active()
    try:
        spark.range(1).select(F.lit("").rlike(pattern)).collect()
    except PySparkException:
        return False
    return True


def match_names(c: Column, include: str | None, exclude: str | None = None) -> Column:
    """Full-match include and exclude patterns; ``*`` is all, an empty or broken include is none."""
    include, exclude = (include or "").strip(), (exclude or "").strip()
    if not include or (include != "*" and not _usable(include)) or (exclude and not _usable(exclude)):
        return F.lit(False)
    keep = F.lit(True) if include == "*" else c.rlike(f"^(?:{include})$")
    return keep & ~c.rlike(f"^(?:{exclude})$") if exclude else keep


def match_table(c: Column, pattern: str | None) -> Column:
    """Case-insensitive table filter, read as a regular expression and as a glob."""
    if pattern is None or pattern.strip() in ("", "*", ".*"):
        return F.lit(True)
    glob = pattern.replace(".", r"\.").replace("*", ".*").replace("?", ".")
    forms = [p for p in dict.fromkeys([pattern, glob]) if _usable(p)]
    hit = F.lit(False)
    for form in forms:
        hit = hit | c.rlike(f"(?i)^(?:{form})$")
    return F.coalesce(hit, F.lit(False))


def excluded_group(c: Column, pattern: str = EXCLUDED_GROUPS) -> Column:
    """Service consumer groups and blank ones."""
    return c.isNull() | (F.trim(c) == "") | F.trim(c).rlike(pattern)


def handled_event(c: Column) -> Column:
    return F.coalesce(F.upper(c).isin(*HANDLED_EVENTS), F.lit(False))


def status_is(status: Column, wanted: str | None, mode: Column) -> Column:
    """Status filter on the bare column; STREAMING also takes rows streaming by mode."""
    if wanted is None or not wanted.strip():
        return F.lit(True)
    hit = status.isin(wanted, wanted.lower())
    return hit | (F.upper(mode) == "STREAMING_INOTIFY") if wanted == "STREAMING" else hit


def not_of_type(kind: Column, types: Sequence[str]) -> Column:
    """Rows whose type is not one of the given; a missing type is kept."""
    return kind.isNull() | ~F.upper(kind).isin(*types)


def visible_to(created_by: Column, principal: Column, owner: str) -> Column:
    """Rows a user may see: nobody's, the system's, own ones, or run as the user."""
    return (
        created_by.isNull()
        | (F.trim(created_by) == "")
        | local_part(created_by).isin("system", owner)
        | F.coalesce(local_part(principal) == owner, F.lit(False))
    )

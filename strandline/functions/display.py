"""Values as people read them: sizes, previews, exact text, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Preview and message limits.
BINARY_PREVIEW_BYTES = 64
TEXT_PREVIEW_CHARS = 65_536
MB = 1024.0 * 1024.0


def fmt_size(size: Column) -> Column:
    """B, KB, MB with one digit, GB with two."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, F.format_string("%.1f KB", size / 1024.0))
        .when(size < 1024**3, F.format_string("%.1f MB", size / MB))
        .otherwise(F.format_string("%.2f GB", size / (MB * 1024.0)))
    )


def _scaled(value: Column, unit: str) -> Column:
    """No digits for a whole number, one when tenths are enough, else two."""
    tenth = F.abs(value % F.lit(0.1))
    return (
        F.when(value % 1 == 0, F.format_string(f"%.0f {unit}", value))
        .when(tenth < 0.01, F.format_string(f"%.1f {unit}", value))
        .otherwise(F.format_string(f"%.2f {unit}", value))
    )


def fmt_memory(mb: Column) -> Column:
    """Megabytes as MB, GB or TB."""
    n = F.coalesce(mb.cast("double"), F.lit(0.0))
    return (
        F.when(F.abs(n) >= 1048576, _scaled(n / 1048576, "TB"))
        .when(F.abs(n) >= 1024, _scaled(n / 1024, "GB"))
        .otherwise(F.format_string("%.0f MB", n))
    )


def fmt_delta(live: Column, draft: Column) -> Column:
    """Signed difference of two amounts in megabytes, empty below 1 MB."""
    d = (draft - live).cast("double")

    def scaled(value: Column, unit: str) -> Column:
        return F.when(value % 1 == 0, F.format_string(f"%.0f {unit}", value)).otherwise(
            F.format_string(f"%.2f {unit}", value)
        )

    text = (
        F.when(F.abs(d) >= 1048576, scaled(d / 1048576, "TB"))
        .when(F.abs(d) >= 1024, scaled(d / 1024, "GB"))
        .otherwise(F.format_string("%.0f MB", d))
    )
    return F.when(F.abs(d) < 1, F.lit("")).otherwise(F.concat(F.when(d > 0, F.lit("+")).otherwise(F.lit("")), text))


def binary_preview(value: Column) -> Column:
    """``0x`` and the first bytes in hex, with the full length when cut."""
    shown = F.concat(F.lit("0x"), F.lower(F.hex(F.substring(value, 1, BINARY_PREVIEW_BYTES))))
    cut = F.concat(shown, F.lit("... ("), F.length(value).cast("string"), F.lit(" bytes)"))
    return F.when(F.length(value) > BINARY_PREVIEW_BYTES, cut).otherwise(shown)


def text_preview(value: Column, limit: int = TEXT_PREVIEW_CHARS) -> Column:
    """Text up to a limit, with the full length when cut."""
    cut = F.concat(F.substring(value, 1, limit), F.lit("... ("), F.length(value).cast("string"), F.lit(" characters)"))
    return F.when(F.length(value) > limit, cut).otherwise(value)


def to_display(df: DataFrame) -> DataFrame:
    """Exact text for decimals, ISO text for dates and times, hex for binary, JSON for nested values."""

    def shown(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(c, {"ignoreNullFields": "false"}).alias(field.name)
        if isinstance(field.dataType, T.BinaryType):
            return binary_preview(c).alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(field.name)
        if isinstance(field.dataType, (T.DecimalType, T.DateType)):
            return c.cast("string").alias(field.name)
        return c.alias(field.name)

    return df.select(*[shown(field) for field in df.schema.fields])


def join_issues(issues: Column, limit: int | None = None) -> Column:
    """Issue texts joined by ``"; "``, cut to a maximum with an ellipsis."""
    text = F.array_join(issues, "; ")
    if limit is None:
        return text
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def split_issues(text: Column) -> Column:
    """The single issue texts; none for a blank text."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def progress_percent(done: Column, total: Column) -> Column:
    """Percent with two digits, never above 100; 0 with nothing to do."""
    share = F.round(done / total * 10000.0) / 100.0
    return F.when(total > 0, F.least(F.lit(100.0), share)).otherwise(F.lit(0.0))


def speed_mb_s(done: Column, elapsed_s: Column) -> Column:
    """Average MB per second with two digits, NULL before the first byte."""
    return F.when(done > 0, F.round(done / MB / F.greatest(elapsed_s, F.lit(1)) * 100.0) / 100.0)


def eta_s(done: Column, total: Column, speed: Column, now_s: Column) -> Column:
    """Expected end in epoch seconds at the current speed."""
    left = F.ceil((total - done) / (speed * MB))
    return F.when((speed > 0) & (total > done), now_s + left)


def lag_ms(now_ms: Column, ts_ms: Column) -> Column:
    """Milliseconds since a moment, never below 0."""
    return F.greatest(F.lit(0).cast("long"), now_ms - ts_ms)


def monotonic(current: Column, reported: Column) -> Column:
    """A counter that never goes down."""
    return F.greatest(F.coalesce(current, F.lit(0)), reported)

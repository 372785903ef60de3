"""Stream records: loop control, payload headers, header enrichment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Record headers and payload formats.
HEADER_ORIGIN = "X-Repl-Origin"
HEADER_HOP = "X-Repl-Hop"
PASSTHROUGH = "PASSTHROUGH"
CONFLUENT = "CONFLUENT_AVRO"
HWX = "HWX_AVRO"
AUTO_DETECT = "AUTO_DETECT"
HEADERS_TYPE = "array<struct<key:string,value:binary>>"


def _text(value: Column) -> Column:
    return F.trim(F.decode(value, "UTF-8"))


def last_header(headers: Column, key: str) -> Column:
    """Value of the last header with exactly this key, NULL without one."""
    hits = F.filter(headers, lambda h: h["key"] == key)
    return F.try_element_at(hits, F.lit(-1))["value"]


def should_replicate(headers: Column, local: str, target: str | None = None, max_hops: int = 3) -> Column:
    """False for records that came from this or the target site, or hopped too often."""
    sites = [s.lower() for s in (local, target) if s is not None]
    echo = F.lower(_text(last_header(headers, HEADER_ORIGIN))).isin(*sites)
    hops = _text(last_header(headers, HEADER_HOP)).try_cast("int")
    return ~F.coalesce(echo, F.lit(False)) & (F.coalesce(hops, F.lit(0)) < max_hops)


def enrich_headers(headers: Column, local: str) -> Column:
    """Keep the origin or add the local site; replace the hop count by one more."""
    given = F.coalesce(headers, F.array().cast(HEADERS_TYPE))
    lower_is = lambda name: lambda h: F.lower(h["key"]) == name.lower()
    is_origin, is_hop = lower_is(HEADER_ORIGIN), lower_is(HEADER_HOP)
    kept = F.transform(
        F.filter(given, lambda h: ~is_hop(h)),
        lambda h: F.struct(
            F.when(is_origin(h), F.lit(HEADER_ORIGIN)).otherwise(h["key"]).alias("key"),
            F.coalesce(h["value"], F.lit(b"")).alias("value"),
        ),
    )
    numbers = F.filter(
        F.transform(F.filter(given, is_hop), lambda h: _text(h["value"]).try_cast("int")), lambda n: n.isNotNull()
    )
    hop = F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.lit(0)) + 1
    header = lambda key, value: F.array(
        F.struct(F.lit(key).alias("key"), F.encode(value, "UTF-8").alias("value"))
    )
    origin = F.when(F.exists(given, is_origin), F.array().cast(HEADERS_TYPE)).otherwise(
        header(HEADER_ORIGIN, F.lit(local))
    )
    return F.concat(kept, origin, header(HEADER_HOP, hop.cast("string")))


def _first_byte(value: Column) -> Column:
    return F.hex(F.substring(value, 1, 1))


def classify_payload(value: Column, configured: str = AUTO_DETECT) -> Column:
    """Payload format; the bytes are looked at only in auto-detect mode."""
    if configured == PASSTHROUGH:
        return F.lit(PASSTHROUGH)
    short = value.isNull() | (F.length(value) < 5)
    if configured != AUTO_DETECT:
        return F.when(short, F.lit(PASSTHROUGH)).otherwise(F.lit(configured))
    first = _first_byte(value)
    return (
        F.when(short, F.lit(PASSTHROUGH))
        .when(first == "00", F.lit(CONFLUENT))
        .when(first.isin("02", "03") & (F.length(value) >= 9), F.lit(HWX))
        .otherwise(F.lit(PASSTHROUGH))
    )


def header_bytes(fmt: Column) -> Column:
    """Length of the schema header of a format."""
    return F.when(fmt == CONFLUENT, F.lit(5)).when(fmt == HWX, F.lit(9)).otherwise(F.lit(0))


def schema_id(value: Column, fmt: Column) -> Column:
    """Schema id in the header (big-endian, signed), NULL without a header.

    Ids read with ``conv`` are unsigned, so they are folded into the signed range.
    """
    small = F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("long")
    small = F.when(small >= 2**31, small - 2**32).otherwise(small)
    big = F.conv(F.hex(F.substring(value, 2, 8)), 16, -10).cast("long")
    return F.when((fmt == CONFLUENT) & (F.length(value) >= 5), small).when(
        (fmt == HWX) & (F.length(value) >= 9), big
    )


def _big_endian(number: Column, width: int) -> Column:
    """Last ``width`` bytes of a number in big-endian order."""
    return F.unhex(F.right(F.lpad(F.hex(number.cast("long")), 16, "0"), F.lit(2 * width)))


def transcode(value: Column, source: Column, target: str, new_id: Column) -> Column:
    """Rewrite the schema header for the target format; the body is left alone.

    Passthrough on either side, and records too short for their header, keep their bytes.
    """
    length = header_bytes(source)
    body = F.substring(value, length + 1, F.length(value))
    same = source == target
    if target == CONFLUENT:
        head = F.concat(F.when(same, F.substring(value, 1, 1)).otherwise(F.lit(b"\x00")), _big_endian(new_id, 4))
    elif target == HWX:
        head = F.concat(F.when(same, F.substring(value, 1, 1)).otherwise(F.lit(b"\x02")), _big_endian(new_id, 8))
    else:
        return value
    keep = (length == 0) | (F.length(value) < length) | new_id.isNull()
    return F.when(value.isNull(), value).when(keep, value).otherwise(F.concat(head, body))

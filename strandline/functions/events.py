"""Bodies of metastore notification events."""

from __future__ import annotations

import base64
import gzip
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Table parameters that are dropped, and the gzip prefix of a format name.
VENDOR_PARAMETERS = ("hdp.version", "STATS_GENERATED_VIA_STATS_TASK", "numFilesErasureCoded", "COLUMN_STATS_ACCURATE")
ACID_REASON = "ACID tables are not supported (transactional=true)"


@F.pandas_udf(T.StringType())
def _gunzip(packed: pd.Series) -> pd.Series:
    def one(raw):
        if raw is None:
            return None
        try:
            return gzip.decompress(bytes(raw)).decode("utf-8")
        except (OSError, EOFError, zlib.error, UnicodeDecodeError):
            return None

    return packed.map(one)


@F.pandas_udf(T.StringType())
def pack_body(text: pd.Series) -> pd.Series:
    """Base64 of the gzipped text: what a compressed event message looks like."""
    return text.map(lambda t: None if t is None else base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode())


def event_body(message: Column, fmt: Column) -> Column:
    """Message text, unpacked where the format says gzip; NULL when it cannot be.

    Only packed messages are handed to the Python worker.
    """
    packed = F.coalesce(F.lower(fmt).startswith("gzip"), F.lit(False))
    raw = F.when(packed, F.try_to_binary(F.trim(message), F.lit("base64")))
    return F.when(packed, _gunzip(raw)).otherwise(message)


_TEXTS = "array<string>"


def _list(json: Column) -> Column:
    return F.from_json(json, _TEXTS)


def _map_values(json: Column) -> Column:
    return F.map_values(F.from_json(json, "map<string,string>"))


def event_partition_values(body: Column) -> Column:
    """Value lists of the partitions an event names, out of five message shapes."""
    field = lambda path: F.get_json_object(body, path)
    items = F.from_json(field("$.partitions"), _TEXTS)
    from_items = F.filter(
        F.transform(
            items,
            lambda item: F.coalesce(
                _list(F.get_json_object(item, "$.values")),
                F.when(F.size(_map_values(item)) > 0, _map_values(item)),
            ),
        ),
        lambda values: values.isNotNull(),
    )
    pairs = _map_values(field("$.keyValues"))
    flat = F.from_json(field("$.partitionValues"), _TEXTS)
    nested = F.transform(flat, lambda v: F.when(v.startswith("["), _list(v)).otherwise(F.array(v)))
    none = F.array().cast("array<array<string>>")
    return F.coalesce(
        F.when(F.size(from_items) > 0, from_items),
        F.when(F.size(pairs) > 0, F.array(pairs)),
        F.when(F.startswith(field("$.values"), F.lit("[")), F.array(_list(field("$.values")))),
        F.when(
            F.startswith(field("$.partition.values"), F.lit("[")), F.array(_list(field("$.partition.values")))
        ),
        nested,
        none,
    )


def event_insert(body: Column) -> Column:
    """Partition values, file names and replace flag of an INSERT event."""
    thrift = F.get_json_object(body, "$.ptnObjJson")
    lst = _list(F.get_json_object(thrift, "$.1.lst"))
    from_thrift = F.slice(lst, F.lit(3), F.greatest(F.size(lst), F.lit(0)))
    pairs = _map_values(F.get_json_object(body, "$.partKeyVals"))
    none = F.array().cast(_TEXTS)
    values = F.when(F.trim(thrift) != "", F.coalesce(from_thrift, none)).otherwise(F.coalesce(pairs, none))
    files = F.transform(
        F.filter(_list(F.get_json_object(body, "$.files")), lambda f: f.isNotNull()),
        lambda f: F.substring_index(F.substring_index(f, "#", 1), "/", -1),
    )
    replace = F.lower(F.get_json_object(body, "$.replace")) == "true"
    return F.struct(
        F.coalesce(values, none).alias("values"),
        F.coalesce(F.array_distinct(files), none).alias("files"),
        F.coalesce(replace, F.lit(False)).alias("replace"),
    )


def event_rename(body: Column) -> Column:
    """Table names before and after, and whether they differ."""
    name = lambda part: F.get_json_object(F.get_json_object(body, f"$.{part}"), "$.1.str")
    before, after = name("tableObjBeforeJson"), name("tableObjAfterJson")
    return F.struct(
        before.alias("before"),
        after.alias("after"),
        F.coalesce(F.lower(before) != F.lower(after), F.lit(False)).alias("is_rename"),
    )


def sanitize_params(params: Column) -> Column:
    """Table parameters without the vendor's own; an empty map for none."""
    kept = F.map_filter(params, lambda k, v: ~k.isin(*VENDOR_PARAMETERS))
    return F.coalesce(kept, F.create_map().cast("map<string,string>"))


def table_support(params: Column) -> Column:
    """Supported or not, with the reason: transactional tables are left out."""
    acid = F.coalesce(F.lower(params["transactional"]) == "true", F.lit(False))
    return F.struct(
        (~acid).alias("supported"), F.when(acid, F.lit(ACID_REASON)).otherwise(F.lit("OK")).alias("reason")
    )

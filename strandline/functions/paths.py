"""File-system paths, locations and partition names as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that mark unfinished or service files and folders.
KEPT_FILES = ("_success", "_success.crc", "_metadata", "_common_metadata")
SYSTEM_FILES = ("thumbs.db", "desktop.ini", ".ds_store")
UNFINISHED_SUFFIXES = (
    ".tmp",
    ".temp",
    ".inprogress",
    ".staging",
    ".pending",
    ".copying",
    ".part",
    ".partial",
    ".swp",
    ".swo",
)
FOLDER_SUFFIXES = (".tmp", ".temp", ".staging")
FILE_STAGING_WORDS = ("hive-staging", "hive_staging", "spark-staging", "spark_staging")
FOLDER_STAGING_WORDS = FILE_STAGING_WORDS + ("tez-staging", "tez_staging")
STAGING_MARKERS = ("/_temporary", "/.hive-staging", "/.spark-staging", "/.staging", "/.tmp", "/.Trash")
STAGED_SUFFIXES = (".tmp", ".crc", ".inprogress")
PRECOMPRESSED = (
    ".parquet",
    ".parq",
    ".orc",
    ".snappy",
    ".sz",
    ".gz",
    ".gzip",
    ".tgz",
    ".zst",
    ".zstd",
    ".lz4",
    ".bz2",
    ".bzip2",
    ".zip",
    ".jar",
    ".war",
    ".xz",
    ".7z",
    ".avro",
)
TEXT_EXTENSIONS = (
    "txt",
    "log",
    "json",
    "xml",
    "yaml",
    "yml",
    "md",
    "sql",
    "sh",
    "py",
    "java",
    "properties",
    "conf",
    "config",
    "env",
    "ini",
    "toml",
)


def _any_of(words: Sequence[str], *, at_end: bool = False) -> str:
    body = "|".join(w.replace("+", r"\+").replace(".", r"\.") for w in words)
    return f"({body})$" if at_end else f"({body})"


def normalize_path(c: Column) -> Column:
    """Path without scheme, authority and outer slashes; backslashes turned."""
    clean = F.trim(F.replace(c, F.lit("\\"), F.lit("/")))
    bare = F.regexp_replace(clean, r"^.*?://[^/]*", "")
    return F.coalesce(F.regexp_replace(bare, r"^/+|/+$", ""), F.lit(""))


def path_of(c: Column) -> Column:
    """Absolute path without scheme and authority, no slash at the end."""
    cut = F.regexp_replace(F.trim(c), r"^[^/]+?://[^/]*|/+$", "")
    return F.coalesce(F.regexp_replace(cut, r"^(?=[^/]|$)", "/"), F.lit("/"))


def ignored_folder(name: Column) -> Column:
    """Hidden, committer, staging and recovery folders; the table log folder is kept."""
    n = F.trim(name)
    low = F.lower(n)
    return (
        (n != "")
        & (low != "_delta_log")
        & (
            n.rlike(r"^[._]")
            | low.startswith("-ext-")
            | low.rlike(_any_of(FOLDER_STAGING_WORDS))
            | (low == "lost+found")
            | low.rlike(_any_of(FOLDER_SUFFIXES, at_end=True))
        )
    )


def ignored_file(name: Column) -> Column:
    """Hidden, system and unfinished files; success markers and summary files are kept."""
    n = F.trim(name)
    low = F.lower(n)
    return (
        (n != "")
        & ~low.isin(*KEPT_FILES)
        & (
            n.startswith(".")
            | low.isin(*SYSTEM_FILES)
            | low.rlike(_any_of(FILE_STAGING_WORDS))
            | low.rlike(_any_of(UNFINISHED_SUFFIXES, at_end=True))
            | n.endswith("~")
            | low.contains("_copying_")
            | low.rlike("^(_temporary|_tmp)")
            | low.rlike(r"\._staging_[a-z0-9_-]+$")
        )
    )


def is_ignored_path(c: Column) -> Column:
    """Any ignored folder on the way, or an ignored file at the end."""
    clean = normalize_path(c)
    segments = F.split(clean, "/+")
    folders = F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))
    hit = F.exists(folders, ignored_folder) | ignored_file(F.element_at(segments, -1))
    return F.when(clean == "", F.lit(False)).otherwise(hit)


def is_staged_path(c: Column) -> Column:
    """Path inside a staging folder or with the suffix of an unfinished write."""
    hit = c.rlike(_any_of(STAGING_MARKERS)) | c.rlike(_any_of(STAGED_SUFFIXES, at_end=True))
    return F.coalesce(hit, F.lit(False))


def is_below(p: Column, r: Column) -> Column:
    """``under_path`` of two paths that are in ``path_of`` form already."""
    return F.coalesce((p == r) | (r == "/") | F.startswith(p, F.concat(r, F.lit("/"))), F.lit(False))


def under_path(c: Column, root: Column) -> Column:
    """Path equal to a root or below it; ``/db.db`` does not take ``/db.dbx``."""
    return c.isNotNull() & root.isNotNull() & is_below(path_of(c), path_of(root))


def depth_below(p: Column, r: Column) -> Column:
    """``depth_under`` of two paths that are in ``path_of`` form already."""
    rest = F.when(r == "/", p).otherwise(F.substring(p, F.length(r) + 1, F.length(p)))
    parts = F.filter(F.split(rest, "/"), lambda x: x != "")
    return F.when(is_below(p, r), F.size(parts)).otherwise(F.lit(-1))


def depth_under(c: Column, root: Column) -> Column:
    """Number of path parts under a root, -1 outside it."""
    return F.when(c.isNull() | root.isNull(), F.lit(-1)).otherwise(depth_below(path_of(c), path_of(root)))


def ancestors(c: Column) -> Column:
    """The path itself and every folder above it but the root, of a path in ``path_of`` form."""
    slashes = F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))
    return F.transform(F.sequence(F.lit(1), slashes), lambda n: F.call_function("substring_index", c, F.lit("/"), n + 1))


def dotted_ancestors(c: Column) -> Column:
    """A dotted path itself and every parent of it."""
    dots = F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    return F.transform(F.sequence(F.lit(1), dots + 1), lambda n: F.call_function("substring_index", c, F.lit("."), n))


def parent_of(c: Column) -> Column:
    """Folder of a file path; empty for a bare name."""
    return F.regexp_replace(c, r"/?[^/]*$", "")


def root_of(target: Column) -> Column:
    """Target root with a leading slash unless it has a scheme, and none at the end."""
    cut = F.regexp_replace(F.trim(target), r"(?<!:/|:)/+$", "")
    return F.when(cut.contains("://"), cut).otherwise(F.regexp_replace(cut, r"^(?=[^/]|$)", "/"))


def moved_path(p: Column, r: Column, target: Column) -> Column:
    """``target_path`` of paths in ``path_of`` and ``root_of`` form already."""
    rest = F.when(r == "/", F.substring(p, F.lit(2), F.length(p))).otherwise(
        F.substring(p, F.length(r) + 2, F.length(p))
    )
    slash = F.when(target.endswith("/"), F.lit("")).otherwise(F.lit("/"))
    inside = F.when((p == r) | (p == "/"), target).otherwise(F.concat(target, slash, rest))
    return F.when(is_below(p, r), inside).otherwise(F.concat(target, F.lit("/"), F.substring_index(p, "/", -1)))


def target_path(c: Column, source_root: Column, target_root: Column) -> Column:
    """Where a file below a source root lies below a target root; outside it, its name there."""
    return moved_path(path_of(c), path_of(source_root), root_of(target_root))


def within_table(part: Column, table: Column) -> Column:
    """Partition location strictly inside the table location."""
    p, t = F.regexp_replace(part, "/+$", ""), F.regexp_replace(table, "/+$", "")
    return F.coalesce(F.startswith(p, F.concat(t, F.lit("/"))), F.lit(False))


def partition_name(keys: Column, values: Column) -> Column:
    """``k=v/k=v``, or the values alone when the counts differ."""
    pairs = F.zip_with(keys, values, lambda k, v: F.concat(k, F.lit("="), v))
    return F.when(F.size(keys) == F.size(values), F.array_join(pairs, "/")).otherwise(F.array_join(values, ","))


def _unescape(c: Column) -> Column:
    """``%XX`` as the character with that code; a broken escape stays as it is.

    The text is cut before every ``%`` so that each piece has one escape at most.
    """
    pieces = F.split(c, "(?=%)")

    def piece(x: Column) -> Column:
        code = F.conv(F.substring(x, 2, 2), 16, 10).cast("int")
        char = F.decode(F.encode(F.chr(code), "ISO-8859-1"), "ISO-8859-1")
        return F.when(x.rlike("^%[0-9A-Fa-f]{2}"), F.concat(char, F.substring(x, F.lit(4), F.length(x)))).otherwise(x)

    return F.array_join(F.transform(pieces, piece), "")


def partition_values(c: Column) -> Column:
    """Values of a partition name, unescaped."""
    return F.transform(
        F.split(c, "/"),
        lambda part: _unescape(
            F.when(part.contains("="), F.substring(part, F.locate("=", part) + 1, F.length(part))).otherwise(part)
        ),
    )


def extension(c: Column) -> Column:
    """Extension in lower case, empty without one."""
    return F.lower(F.regexp_extract(c, r"\.([^./]+)$", 1))


def file_type(c: Column) -> Column:
    """How a file is previewed: its format, ``text`` or ``binary``.

    Unknown extensions of up to four characters are read as text, like no extension.
    """
    e = extension(c)
    return (
        F.when(e.isin("csv", "tsv", "orc"), e)
        .when(e.isin("parquet", "parq"), F.lit("parquet"))
        .when(e.isin(*TEXT_EXTENSIONS) | (F.length(e) <= 4), F.lit("text"))
        .otherwise(F.lit("binary"))
    )


def codec_for(c: Column, configured: str) -> Column:
    """Wire codec of a file: formats that are compressed already are left alone."""
    packed = F.lower(c).rlike(_any_of(PRECOMPRESSED, at_end=True))
    return F.when(F.coalesce(packed, F.lit(False)), F.lit("NONE")).otherwise(F.lit(configured))


def is_up_to_date(exists: Column, src_size: Column, src_mtime: Column, tgt_size: Column, tgt_mtime: Column) -> Column:
    """Same non-zero size, and a target no older unless a time is unknown (<= 0)."""
    times = (src_mtime <= 0) | (tgt_mtime <= 0) | (tgt_mtime >= src_mtime)
    return F.coalesce(exists & (src_size > 0) & (src_size == tgt_size) & times, F.lit(False))


def delete_allowed(p: Column, r: Column, sync: Column, companion: Column, dirs: Column, inside: Column) -> Column:
    """Whether a delete is carried over, by the job's flags and the depth of the path below its root.

    Both paths are in ``path_of`` form.
    """
    depth = depth_below(p, r)
    return (
        F.when(~sync, F.lit(False))
        .when(~companion, F.lit(True))
        .when(depth <= 0, F.lit(False))
        .when(depth == 1, dirs)
        .otherwise(inside)
    )

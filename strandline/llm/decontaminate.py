"""Benchmark decontamination: a broadcast hash set of test n-grams scanned over whole texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import tokens
from strandline.llm.tables import ALNUM_WORD, ascii_lower, settled

WINDOW = 13
#: Windows in one broadcast set. A larger benchmark is scanned in several sets, one pass over
#: the texts each. Windows are dealt one by one, by hash, so that no item, however large,
#: makes a set outgrow this by more than the chance of the hash.
SET_WINDOWS = 500_000

SPANS = "doc_id long, n_words long, spans array<struct<first:long,past:long>>, items array<string>, row string"
_SPAN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``item_id, width, window`` for every window of every item.

    A window is ``size`` consecutive words joined by spaces; an item with fewer words,
    but not none, is one window. A null item id becomes the empty string.
    """
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(ALNUM_WORD), F.lit(0))
    width = F.least(F.size("words"), F.lit(size))
    return (
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words.alias("words"))
        .where("size(words) > 0")
        .select("item_id", "words", width.alias("width"))
        .select("item_id", "width", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("width") + 1)).alias("at"))
        .select("item_id", "width", F.array_join(F.slice("words", F.col("at"), F.col("width")), " ").alias("window"))
        .distinct()
    )


def _rows(windows: DataFrame) -> list[tuple[str, int, str]]:
    return [tuple(r) for r in windows.select("item_id", "width", "window").collect()]


class _WindowSet:
    """Windows by width: sorted hashes behind a bit map, and the words to verify a hit."""

    def __init__(self, rows: list[tuple[str, int, str]]):
        by_width = defaultdict(list)
        for item, width, window in rows:
            by_width[width].append((window.encode(), item))
        self.widths = {}
        for width, found in by_width.items():
            column = pa.array([w.decode() for w, _ in found])
            items: dict[int, dict[bytes, list[str]]] = defaultdict(lambda: defaultdict(list))
            at = 0
            for _, _, block in tokens.blocks(column, tokens.NOT_ALNUM, lower=False):
                for h in tokens.shingles(block.hash, width)[block.first[:-1]] if len(block.hash) else []:
                    text, item = found[at]
                    items[int(h)][text].append(item)
                    at += 1
            hashes = np.array(sorted(items), np.uint64)
            map_ = np.zeros(1 << 20, bool)
            map_[hashes >> np.uint64(44)] = True
            self.widths[width] = (hashes, map_, {h: dict(x) for h, x in items.items()})


def _texts_scanned(values: pa.Array, known: dict) -> Iterator[tuple[int, list, list]]:
    """Per text: number of words, joined hit spans, sorted items with occurring windows."""
    for i, j, block in tokens.blocks(values, tokens.NOT_ALNUM):
        found: dict[int, tuple[list, set]] = defaultdict(lambda: ([], set()))
        for width, (hashes, map_, texts) in known.items():
            grams = tokens.shingles(block.hash, width)
            if not len(grams):
                continue
            at = np.flatnonzero(map_[grams >> np.uint64(44)])
            at = at[block.doc[at] == block.doc[at + width - 1]]
            at = at[hashes[np.minimum(np.searchsorted(hashes, grams[at]), len(hashes) - 1)] == grams[at]]
            for k in at.tolist():
                owners = texts[int(grams[k])].get(b" ".join(block.word(w) for w in range(k, k + width)))
                if owners:
                    doc = int(block.doc[k])
                    begin = k - int(block.first[doc])
                    found[doc][0].append((begin, begin + width))
                    found[doc][1].update(owners)
        n_words = np.diff(block.first).tolist()
        for doc in range(j - i):
            spans, items = found.get(doc, ((), ()))
            yield n_words[doc], _joined(spans), sorted(items)


def _scan(windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WindowSet(windows.value).widths
        for batch in batches:
            scanned = list(_texts_scanned(batch.column(1), known))
            spans = [[{"first": a, "past": b} for a, b in x[1]] for x in scanned]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[0] for x in scanned], pa.int64()),
                    pa.array(spans, _SPAN_TYPE),
                    pa.array([x[2] for x in scanned], pa.list_(pa.string())),
                    batch.column(2),
                ],
                names=["doc_id", "n_words", "spans", "items", "row"],
            )

    return run


def _clean(n_words: int, spans: list[tuple[int, int]]) -> bool:
    n_hit = sum(b - a for a, b in spans)
    return not (n_hit > 0 and 20 * n_hit >= n_words)


def _drop(windows, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WindowSet(windows.value).widths
        for batch in batches:
            keep = [_clean(n, spans) for n, spans, _ in _texts_scanned(batch.column(column), known)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _joined(spans) -> list[tuple[int, int]]:
    """Sorted spans, overlapping and touching ones as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _merge(rows: list) -> tuple[list[dict], list[str]]:
    spans = _joined([(s["first"], s["past"]) for r in rows for s in r["spans"]])
    return [{"first": a, "past": b} for a, b in spans], sorted({x for r in rows for x in r["items"]})


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, set_windows: int = SET_WINDOWS) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans``.

    Words are runs of digits, a-z (after lower-casing A-Z) and characters beyond ASCII.
    ``spans`` are the word ranges inside occurrences of benchmark windows, ``n_hit`` the
    words in them, each counted once; ``n_items`` the items with an occurring window
    and ``items_sha256`` the digest of their ids, sorted as strings and comma-joined.
    A document is contaminated if at least a twentieth of its words is hit.

    The benchmark's windows are counted first. Up to ``set_windows`` of them go out as one
    broadcast set; more are dealt to several sets one by one, and the texts are scanned
    once for each set, results of one document being joined. Hash hits are verified on
    the words. Null and empty texts have no words and are clean; so is everything against an
    empty benchmark. Repeated ids are scanned row by row. Other columns are ignored.
    """
    spark = docs.sparkSession
    windows = item_windows(benchmark, size)
    n = windows.count()
    parts = max(1, -(-n // set_windows))
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        (F.expr("uuid()") if parts > 1 else F.lit("")).alias("row"),
    )
    if parts > 1:  # the rows need a name that holds over the passes
        texts = settled(texts, "texts")
    found = _found(texts, windows, parts).select(
        "doc_id", "n_words", _n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans"
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        _contaminated(F.col("n_hit")).alias("contaminated"),
        "spans",
    )


def _n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["past"] - s["first"])


def _contaminated(n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


def _found(texts: DataFrame, windows: DataFrame, parts: int) -> DataFrame:
    """``doc_id, n_words, spans, items, row`` per row of ``texts``, over one pass or several."""
    spark = texts.sparkSession
    found = None
    for part in range(parts):
        own = _rows(windows.where(F.pmod(F.xxhash64("item_id", "window"), F.lit(parts)) == part))
        hits = texts.mapInArrow(_scan(spark.sparkContext.broadcast(own)), SPANS)
        found = hits if found is None else found.union(hits)
    if parts > 1:
        merged = F.udf(_merge, "spans array<struct<first:long,past:long>>, items array<string>")
        found = (
            found.groupBy("row", "doc_id")
            .agg(F.max("n_words").alias("n_words"), F.collect_list(F.struct("spans", "items")).alias("parts"))
            .select("doc_id", "n_words", merged("parts").alias("m"), "row")
            .select("doc_id", "n_words", "m.spans", "m.items", "row")
        )
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        spans = batch.column(2).to_pylist()
        row = 0
        for i, j, block in tokens.blocks(batch.column(1), tokens.NOT_ALNUM, lower=False):
            for doc in range(j - i):
                a, b = int(block.offset[doc]), int(block.offset[doc + 1])
                keep, at = [], a
                for s in spans[row] or []:
                    first = int(block.first[doc])
                    keep.append(block.data[at : block.start[first + s["first"]]])
                    at = int(block.end[first + s["past"] - 1])
                keep.append(block.data[at:b])
                out.append(b"".join(keep).decode() if spans[row] else batch.column(1)[row].as_py())
                row += 1
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def without_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, text`` with the hit words of every document cut out; the rest stays as it is.

    ``found`` comes from ``contamination``; ids must be unique. Upper-case letters count
    as letters here as there.
    """
    rows = docs.select("doc_id", "text").join(found.select("doc_id", "spans"), "doc_id", "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, text string")


def without_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, set_windows: int = SET_WINDOWS) -> DataFrame:
    """The documents that are not contaminated, all columns as they were.

    With one broadcast set the rows are filtered where they are read, without a shuffle.
    With several sets every row gets a name, by which it is joined to its own verdict. Ids may
    be null or repeated either way.
    """
    windows = item_windows(benchmark, size)
    n = windows.count()
    if n > set_windows:
        row = "row"
        while row in docs.columns:
            row += "_"
        named = settled(docs.withColumn(row, F.expr("uuid()")), "texts")
        texts = named.select(
            F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(row).alias("row")
        )
        bad = _found(texts, windows, -(-n // set_windows)).where(_contaminated(_n_hit())).select(F.col("row").alias(row))
        return named.join(bad, row, "left_anti").select(*docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(_rows(windows))
    return docs.mapInArrow(_drop(sent, docs.columns.index("text")), docs.schema)

"""License scans: an exact set-containment join of text blocks with license templates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import tokens
from strandline.llm.tables import settled

#: Fixed phrases of the base scan: words that stand one after the other, and their label.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices in the words of the licenses; a block (a run of words) that holds the share of a notice's distinct
#: words gets its label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
)
#: Share of a template's words, in hundredths.
CONTAINED = 90
#: Words of a block as a multiple of its template's words. Blocks know no line breaks, so
#: a notice is found however it is wrapped, and words scattered over a long line are none.
SPREAD = 2


def _hash_of(words: list[str]) -> np.ndarray:
    """Hashes of single words, as the scan computes them."""
    _, _, block = next(tokens.blocks(pa.array([" ".join(words)]), tokens.NOT_ALNUM, target=1 << 30))
    return block.hash


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted(set(chain.from_iterable(t.split() for _, t in templates)))


class _Finder:
    """Places of a few known words in arrays of word hashes, through a bit map."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.map = np.zeros(1 << 20, bool)
        self.map[hashes >> np.uint64(44)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.map[h >> np.uint64(44)])
        found = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        same = self.sorted[found] == h[at]
        return at[same], self.order[found[same]]


def _count(words: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = _Finder(_hash_of(words)), np.zeros(len(words), np.int64)
        for batch in batches:
            for _, _, block in tokens.blocks(batch.column(0), tokens.NOT_ALNUM):
                total += np.bincount(find(block.hash)[1], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(total)], names=["word", "n"])

    return run


def rarity(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Rank of each template word, 0 the rarest over all texts; ties by the word."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count(vocabulary(templates)), "word string, n long")
    found = {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    order = sorted(vocabulary(templates), key=lambda w: (found.get(w, 0), w))
    return {w: k for k, w in enumerate(order)}


def template_rows(spark: SparkSession, rank: dict[str, int], templates=TEMPLATES, share: int = CONTAINED) -> DataFrame:
    """``template, label, need, width, words`` with words as ranks, the rarest first."""
    rows = []
    for k, (label, text) in enumerate(templates):
        words = sorted(rank[w] for w in set(text.split()))
        rows.append((k, label, -(-len(words) * share // 100), SPREAD * len(text.split()), words))
    return spark.createDataFrame(rows, "template int, label string, need int, width int, words array<int>")


_BLOCK = pa.list_(pa.struct([("width", pa.int32()), ("words", pa.list_(pa.int32())), ("ats", pa.list_(pa.int64()))]))


def _prefixes(templates: list) -> list[tuple[int, int, np.ndarray]]:
    """Per width of a block: the least need of a template, and all words of which a template's block holds one."""
    out = {}
    for t in templates:
        need, rare = out.get(t["width"], (t["need"], set()))
        out[t["width"]] = min(need, t["need"]), rare | set(t["words"][: len(t["words"]) - t["need"] + 1])
    return [(width, need, np.array(sorted(rare))) for width, (need, rare) in sorted(out.items())]


def _blocks(block: tokens.Block, at: np.ndarray, word: np.ndarray, width: int, need: int, prefix: np.ndarray):
    """Blocks that may hold a template: ``text, {word: its first place}`` for each.

    A block holds ``width`` words from a known word on, or fewer at the end of the text. It
    is handed on if it has ``need`` known words and one of a template's prefix, and if its words
    differ from those of the last one handed on or it lies beyond that one, so a text of
    nothing but notices gives a block per ``width`` words. Which template it holds, if
    any, is for the join.
    """
    doc = block.doc[at]
    past = np.searchsorted(at, np.minimum(at + width, block.first[doc + 1]))
    rare = np.r_[0, np.cumsum(np.isin(word, prefix))]
    new = np.r_[True, past[1:] > past[:-1]][: len(at)]  # else the block before holds all of it
    last, end = None, -1
    for k in np.flatnonzero(new & (past - np.arange(len(at)) >= need) & (rare[past] > rare[:-1])).tolist():
        held = dict(zip(reversed(word[k : past[k]].tolist()), reversed((at[k : past[k]] - block.first[doc[k]]).tolist())))
        if len(held) >= need and (at[k] >= end or held.keys() != last):
            last, end = held.keys(), min(int(at[k]) + width, int(block.first[doc[k] + 1]))
            yield int(doc[k]), held


def _scan(order: list[str], templates: list):
    """Words, phrase places, and all blocks that may hold a template, their known words by rank."""
    widths = _prefixes(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Finder(_hash_of(order))
        phrases = [(p.split(), label) for p, label in PHRASES.items()]
        keys = [tokens.shingles(_hash_of(w), len(w))[0] for w, _ in phrases]
        for batch in batches:
            n_words, places, blocks = [], [], []
            for i, j, block in tokens.blocks(batch.column(2), tokens.NOT_ALNUM):
                own_places: dict[int, list] = {}
                own_blocks: dict[int, list] = {}
                n_words.extend(np.diff(block.first).tolist())
                for (words, label), key in zip(phrases, keys):
                    grams = tokens.shingles(block.hash, len(words))
                    for k in np.flatnonzero(grams == key).tolist():
                        last = k + len(words) - 1
                        if block.doc[k] == block.doc[last] and [block.word(w).decode() for w in range(k, last + 1)] == words:
                            doc = int(block.doc[k])
                            own_places.setdefault(doc, []).append((k - int(block.first[doc]), label))
                at, word = find(block.hash)
                for width, need, prefix in widths:
                    for d, held in _blocks(block, at, word, width, need, prefix):
                        words = sorted(held)
                        own_blocks.setdefault(d, []).append({"width": width, "words": words, "ats": [held[w] for w in words]})
                for d in range(j - i):
                    places.append([{"at": a, "label": x} for a, x in sorted(own_places.get(d, ()))])
                    blocks.append(own_blocks.get(d, []))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(n_words, pa.int64()),
                    pa.array(places, pa.list_(pa.struct([("at", pa.int64()), ("label", pa.string())]))),
                    pa.array(blocks, _BLOCK),
                ],
                names=["row", "doc_id", "n_words", "places", "blocks"],
            )

    return run


def licensed_blocks(scanned: DataFrame, templates: DataFrame) -> DataFrame:
    """``row, template, label, at, share``: all blocks that hold enough of a template's words.

    Length filter: a block must hold as many known words as the template needs. Prefix
    filter: of a template of m words that needs k of them, it must hold one of the
    m - k + 1 rarest. Positional filter: from the first shared word on, both must have
    enough words left. What is left is verified on the whole word sets. Blocks of a template that
    overlap are one, reported by its fullest (the first of them): ``at`` is the first place
    of one of the template's words.
    """
    blocks = scanned.select("row", F.posexplode("blocks").alias("block", "b")).select("row", "block", "b.width", "b.words", "b.ats")
    needs = templates.groupBy("width").agg(F.min("need").alias("least"))
    probe = blocks.join(needs, "width").where("size(words) >= least")
    probe = probe.select("row", "block", "width", F.col("words").alias("held"), "ats", F.posexplode("words").alias("j", "word"))
    prefix = templates.select(
        "template", "label", "need", "width", "words",
        F.posexplode(F.slice("words", F.lit(1), F.size("words") - F.col("need") + 1)).alias("i", "word"),
    )
    left = F.least(F.size("words") - F.col("i"), F.size("held") - F.col("j"))
    met = probe.join(prefix, ["width", "word"]).where(F.size("held") >= F.col("need"))
    shares = Window.partitionBy("row", "block", "template").orderBy("i")
    # only where the first shared word stands does the number of words left bound the overlap
    first = met.withColumn("n", F.row_number().over(shares)).where((F.col("n") == 1) & (left >= F.col("need")))
    common = F.array_intersect("held", "words")
    own = F.filter("ats", lambda at, k: F.array_contains("words", F.get("held", k)))
    verified = (
        first.withColumn("common", F.size(common))
        .where("common >= need")
        .select("row", "template", "label", "width", F.array_min(own).alias("at"), (F.col("common") / F.size("words")).alias("share"))
    )
    along = Window.partitionBy("row", "template").orderBy("at", F.desc("share"))
    apart = F.coalesce(F.col("at") - F.lag("at").over(along) >= F.col("width"), F.lit(True))
    numbered = verified.withColumn("starts", apart.cast("int")).withColumn("no", F.sum("starts").over(along))
    fullest = F.max(F.struct("share", (-F.col("at")).alias("before")))
    return (
        numbered.groupBy("row", "template", "label", "no")
        .agg(fullest.alias("m"))
        .select("row", "template", "label", (-F.col("m.before")).alias("at"), "m.share")
    )


def _scanned(docs: DataFrame, templates) -> tuple[DataFrame, DataFrame]:
    """Per row its words, phrase places and possible blocks; all blocks that hold a template."""
    spark = docs.sparkSession
    rank = rarity(docs, templates)
    table = settled(template_rows(spark, rank, templates), "license-templates")
    known = table.select("need", "width", "words").collect()
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    schema = (
        "row long, doc_id long, n_words long, places array<struct<at:long,label:string>>, "
        "blocks array<struct<width:int,words:array<int>,ats:array<bigint>>>"
    )
    scanned = settled(rows.mapInArrow(_scan(sorted(rank, key=rank.get), known), schema), "license-blocks")
    return scanned, licensed_blocks(scanned, table)


def license_blocks(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``doc_id, at, label, share``: every notice of a template, several in a text too.

    ``templates`` are pairs of a label and the words of a notice; the other rules are those of
    ``license_scan``. Texts without a notice have no row.
    """
    scanned, found = _scanned(docs, templates)
    return found.join(scanned.select("row", "doc_id"), "row").select("doc_id", "at", "label", "share")


def license_scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per row ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_notices``.

    Words are runs of digits, a-z (after lower-casing A-Z) and characters beyond ASCII. Base:
    places where a phrase's words stand one after the other, with smallest and largest
    start. Blocks are all runs of ``SPREAD`` times as many words as a template has, across
    lines; a template of which a block holds at least ``CONTAINED`` per cent of the
    distinct words adds its label. ``n_notices`` counts such blocks, overlapping ones of a template
    as one. ``score`` is 1 with a base place, else the largest share of a template that was
    found, else 0. Null text counts as empty; repeated rows are judged each; other columns are
    ignored.
    """
    scanned, blocks = _scanned(docs, templates)
    found = blocks.groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max("share").alias("share"), F.count("*").alias("n_notices")
    )
    at, base = F.transform("places", lambda p: p["at"]), F.array_distinct(F.transform("places", lambda p: p["label"]))
    more = F.coalesce("more", F.array().cast("array<string>"))
    return scanned.drop("blocks").join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
    )

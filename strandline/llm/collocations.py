"""Phrase collocation mining by top-order marginalisation.

Every word opens one window of the next ``longest`` words of its piece, padded with nulls
where the piece ends. Only these windows are counted; a ROLLUP over (language, word 1,
..., word ``longest``) sums them to the counts of all shorter phrases and of all words, as
every occurrence of a phrase is the prefix of exactly one window.

A phrase counted ``least`` times holds only words and phrases counted as often. So two
passes before count words and pairs, then longer phrases of frequent pairs, in tables of
hashed counters of a bounded size, and a window is cut after the last phrase whose counter
reaches ``least``: no phrase that can be reported is lost, and nearly all windows fall
together within their task. Where a corpus fills the tables, windows stay longer and counts
stay right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm import tokens
from strandline.llm.tables import settled

LEAST, LONGEST, TOP, SHARE = 100, 5, 2000, 100
#: Language of documents without one.
UNDETERMINED = "und"
#: The counter table has a counter for so many bytes of text, between these powers of two;
#: broadcast is one bit of each, 32 MB at most.
BYTES_A_COUNTER, SMALLEST, LARGEST = 32, 20, 28
#: Counters of one row of the table; words that are counted together in a task, and different
#: windows that it holds before it passes them on.
SLICE, WORDS, HELD = 1 << 16, 1 << 19, 1 << 19
#: Bytes of text of a task that counts windows, unless that leaves cores idle. Each task passes on
#: nearly every frequent phrase once, so small tasks multiply the rows.
TASK_BYTES = 1 << 26

_bytes = np.arange(256)
_BREAK = np.isin(_bytes, list(b".,;:!?\n\x0b\x0c\r"))
_OUTSIDE = _BREAK | np.isin(_bytes, list(b" \t"))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_FIRST = np.uint64(1)


def _pieces(batches: Iterator[pa.RecordBatch]):
    """(words, whether a word's successor stands in the same piece, language of each text) per block."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for i, j, block in tokens.blocks(batch.column(1), _OUTSIDE):
            if not len(block.start):
                continue
            breaks = np.cumsum(_BREAK[np.frombuffer(block.data, np.uint8)])[block.start]
            joined = np.zeros(len(breaks), bool)
            joined[:-1] = (breaks[1:] == breaks[:-1]) & (block.doc[1:] == block.doc[:-1])
            yield block, joined, langs[i:j]


def _by_language(langs: list[str], seen: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Number in ``seen`` and hash of the language of each text."""
    numbers = np.array([seen.setdefault(name, len(seen)) for name in langs], np.int64)
    own = tokens.cut_words(b"".join(n.encode() + b"\0" for n in seen), np.cumsum([0] + [len(n.encode()) + 1 for n in seen]), np.zeros(256, bool)).hash
    return numbers, own[numbers]


def _ahead(a: np.ndarray, by: int = 1) -> np.ndarray:
    """The value ``by`` words later; nothing (0, False) past the end."""
    out = np.zeros_like(a)
    out[: len(a) - by] = a[by:]
    return out


def _grams(block: tokens.Block, joined: np.ndarray, language: np.ndarray, tables: list[tuple[np.ndarray, int]], longest: int):
    """(length, hash, possible) of the phrase of each length that starts at each word.

    A phrase is possible within its piece, where ``tables`` (those known so far) count it
    often enough, and where the phrases of all its parts are possible.
    """
    h = block.hash
    key = tokens.mix(h ^ language)
    possible = np.ones(len(h), bool)
    for size in range(1, longest + 1):
        if size > 1:
            key = tokens.mix(key * _STEP + _ahead(h, size - 1))
            possible = possible & _ahead(possible)
        if size == 2:
            possible &= joined
        table = _table_of(size)
        if table < len(tables):
            bits, power = tables[table]
            at = np.flatnonzero(possible)
            slot = key[at] >> np.uint64(64 - power)
            possible[at] = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7))).astype(np.uint8)) & 1 == 1
        yield size, key, possible


def _table_of(size: int) -> int:
    """Words and pairs are counted first, longer phrases of frequent pairs in a second pass."""
    return 0 if size <= 2 else 1


def _count_slots(power: int, least: int, longest: int, known: list[tuple[Broadcast, int]]):
    """Counters of a task's phrases, sparse, a row per slice of the table; no count above ``least`` is needed."""
    kind = np.uint8 if least <= 255 else np.uint32

    def rows_of(parts: list[np.ndarray]) -> pa.RecordBatch:
        slots = np.sort(np.concatenate(parts))
        first = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
        counts = np.minimum(np.diff(np.r_[first, len(slots)]), least).astype(kind)
        slots = slots[first]
        part = slots // SLICE
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        low = (slots % SLICE).astype(np.uint16)
        ends = np.r_[edge[1:], len(slots)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(part[edge].astype(np.int32)),
                pa.array([low[a:b].tobytes() for a, b in zip(edge, ends)], pa.binary()),
                pa.array([counts[a:b].tobytes() for a, b in zip(edge, ends)], pa.binary()),
            ],
            ["slice", "slots", "counts"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        n = 0
        tables = [(t.value, p) for t, p in known]
        for block, joined, langs in _pieces(batches):
            _, language = _by_language(langs, {})
            for size, key, possible in _grams(block, joined, language[block.doc], tables, longest):
                if _table_of(size) == len(tables):
                    parts.append((key[possible] >> np.uint64(64 - power)).astype(np.uint32))
                    n += len(parts[-1])
            if n >= 2 * WORDS:
                yield rows_of(parts)
                parts, n = [], 0
        if n:
            yield rows_of(parts)

    return count


def _sum_slots(least: int):
    """Slices dealt to a task, summed in a stream and reduced to a bit per counter."""
    kind = np.uint8 if least <= 255 else np.uint32

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, slots, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if part not in sums:
                    sums[part] = np.zeros(SLICE, np.uint32)
                # no overflow: a counter stops where it is known to be frequent
                at = np.frombuffer(slots, np.uint16)
                sums[part][at] = np.minimum(sums[part][at] + np.frombuffer(counts, kind), least)
        if sums:
            bits = [np.packbits(s >= least).tobytes() for s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], ["slice", "bits"])

    return add


def _in_large_tasks(texts: DataFrame, size: int) -> DataFrame:
    """The texts (``size`` bytes) in tasks of about TASK_BYTES, in two tasks a core at least where there are as many."""
    return texts.coalesce(max(2 * texts.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def _frequent(texts: DataFrame, least: int, longest: int) -> list[tuple[Broadcast, int]]:
    """Bit maps of the counters that reach ``least``, on every executor, each with its power of two."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    power = min(LARGEST, max(SMALLEST, int(size // BYTES_A_COUNTER).bit_length()))
    known: list[tuple[Broadcast, int]] = []
    for _ in range(_table_of(longest) + 1):
        counted = texts.mapInArrow(_count_slots(power, least, longest, known), "slice int, slots binary, counts binary")
        rows = counted.repartition("slice").mapInArrow(_sum_slots(least), "slice int, bits binary").collect()
        table = np.zeros((1 << power) // 8, np.uint8)
        for r in rows:  # at most 2 ** LARGEST / 8 bytes in all
            table[r.slice * SLICE // 8 : (r.slice + 1) * SLICE // 8] = np.frombuffer(r.bits, np.uint8)
        known = [*known, (spark.sparkContext.broadcast(table), power)]
    return known


class _Windows:
    """Windows of a task, counted once each: hashes of their words, and each different word."""

    def __init__(self, longest: int):
        self.key = np.zeros(0, np.uint64)
        self.count = np.zeros(0, np.int64)
        self.lang = np.zeros(0, np.int64)
        self.words = np.zeros((0, longest), np.uint64)
        self.size = np.zeros(0, np.int64)
        self.known = np.zeros(0, np.uint64)
        self.text: dict[int, str] = {}

    def add(self, held: list) -> None:
        data, start, end, h, reach, lang, key = zip(*held)
        base = np.cumsum([0] + [len(d) for d in data])
        data = b"".join(data)
        start = np.concatenate([s + at for s, at in zip(start, base)])
        end = np.concatenate([e + at for e, at in zip(end, base)])
        h, reach, lang, key = (np.concatenate(x) for x in (h, reach, lang, key))
        longest = self.words.shape[1]
        for j in range(longest):
            key = tokens.mix(key * _STEP + np.where(reach > j, _ahead(h, j), _FIRST))
        key, first, count = np.unique(key, return_index=True, return_counts=True)
        at = first[:, None] + np.arange(longest)
        inside = np.arange(longest) < reach[first][:, None]
        words = np.where(inside, h[np.minimum(at, len(h) - 1)], 0)
        used, own = np.unique(h[at[inside]], return_index=True)
        new = ~np.isin(used, self.known, assume_unique=True)
        place = at[inside][own[new]]
        self.text.update(zip(used[new].tolist(), [data[a:b].decode() for a, b in zip(start[place].tolist(), end[place].tolist())]))
        self.known = np.union1d(self.known, used)
        key, count = np.r_[self.key, key], np.r_[self.count, count]
        self.key, pick, same = np.unique(key, return_index=True, return_inverse=True)
        self.count = np.zeros(len(self.key), np.int64)
        np.add.at(self.count, same, count)
        self.lang = np.r_[self.lang, lang[first]][pick]
        self.size = np.r_[self.size, reach[first]][pick]
        self.words = np.r_[self.words, words][pick]

    def rows(self, langs: list[str]) -> Iterator[pa.RecordBatch]:
        longest = self.words.shape[1]
        vocabulary = pa.array([self.text[w] for w in self.known.tolist()], pa.string())
        names = pa.array(langs, pa.string())
        for a in range(0, len(self.key), 1 << 15):
            cut = slice(a, a + (1 << 15))
            place = np.searchsorted(self.known, self.words[cut])
            columns = [vocabulary.take(pa.array(place[:, j], mask=self.size[cut] <= j)) for j in range(longest)]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(self.lang[cut])), *columns, pa.array(self.count[cut])], ["lang", *_columns(longest), "n"])


def _count_windows(known: list[tuple[Broadcast, int]], longest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        windows = _Windows(longest)
        held: list = []
        n = 0
        tables = [(t.value, p) for t, p in known]
        for block, joined, langs in _pieces(batches):
            number, language = _by_language(langs, seen)
            number, language = number[block.doc], language[block.doc]
            # words of a window: up to the first that no frequent phrase can reach, 0 for a rare first word
            reach = sum(possible.astype(np.int64) for _, _, possible in _grams(block, joined, language, tables, longest))
            held.append((block.data, block.start, block.end, block.hash, reach, number, language))
            n += len(reach)
            if n >= WORDS:
                windows.add(held)
                held, n = [], 0
                if len(windows.key) >= HELD:
                    yield from windows.rows(list(seen))
                    windows = _Windows(longest)
        if held:
            windows.add(held)
        yield from windows.rows(list(seen))

    return count


def _columns(longest: int) -> list[str]:
    return [f"w{k}" for k in range(1, longest + 1)]


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, words, n of every word and phrase of up to ``longest`` words with at least ``least`` occurrences, by language.

    A row without words holds the number of all word occurrences of its language.
    """
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNDETERMINED)).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    known = _frequent(texts, least, longest)
    columns = _columns(longest)
    schema = "lang string, " + ", ".join(f"{c} string" for c in columns) + ", n long"
    windows = _in_large_tasks(texts, size).mapInArrow(_count_windows(known, longest), schema)
    summed = windows.rollup("lang", *columns).agg(F.sum("n").alias("n"), F.grouping_id().alias("left_out"))
    # a prefix of k words leaves out longest - k columns; a padded one repeats a shorter prefix
    words = F.filter(F.array(*columns), lambda w: w.isNotNull())
    size = F.lit(longest) - F.bit_count("left_out")
    return (
        summed.select("lang", words.alias("words"), "n", size.alias("size"))
        .where((F.col("size") >= 0) & (F.size("words") == F.col("size")) & ((F.col("size") == 0) | (F.col("n") >= least)))
        .drop("size")
    )


def _text(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, share: int = SHARE) -> DataFrame:
    """The phrases of 2 to ``longest`` words that occur together more than their parts let expect, by language.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into
    words at spaces and tabs. A candidate occurs ``a`` >= ``least`` times; cut after its
    first words it has parts with counts ``l`` and ``r``, and the cut with the smallest
    floor(1000 * a * n / (l * r)) decides (ties: the shortest first part), ``n`` being all
    words of the language. Products are decimals: exact for counts up to 10**17. Candidates
    inside a longer one with at least ``share`` % of their occurrences are dropped. Returns
    lang, rank, phrase, a, l, r, n, score: the ``top`` first of each language (None: all) by
    score, a (both descending) and phrase (UTF-8 bytes). Null text counts as empty, null
    lang as ``und``; repeated rows count again; other columns are ignored; an empty table
    gives no rows.
    """
    known = settled(phrase_counts(docs, least, longest), "phrases")
    total = known.where(F.size("words") == 0).select("lang", F.col("n").alias("total"))
    counts = known.where(F.size("words") > 0).select("lang", _text(F.col("words")).alias("phrase"), "words", F.col("n").alias("a"))
    several = counts.where(F.size("words") > 1)

    cuts = several.select(
        "lang", "phrase", "a", F.size("words").alias("size"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"), "words"
    ).select(
        "lang", "phrase", "a", "size", "cut", "words",
        _text(F.expr("slice(words, 1, cut)")).alias("front"), _text(F.expr("slice(words, cut + 1, size - cut)")).alias("rest"),
    )
    part = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    big = lambda name: F.col(name).cast("decimal(18,0)")
    scored = (
        cuts.join(part("front", "l"), ["lang", "front"])
        .join(part("rest", "r"), ["lang", "rest"])
        .join(total, "lang")
        .withColumn("product", F.lit(1000).cast("decimal(4,0)") * (big("a") * big("total")))
        .withColumn("score", F.expr("product div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))").cast("long"))
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"), F.first("a").alias("a"), F.first("total").alias("n"))
    )
    inner = several.where(F.size("words") > 2).select("lang", "a", "words", F.size("words").alias("size"))
    inner = inner.withColumn("length", F.explode(F.expr("sequence(2, size - 1)")))
    inner = inner.withColumn("at", F.explode(F.expr("sequence(1, size - length + 1)")))
    around = inner.groupBy("lang", _text(F.expr("slice(words, at, length)")).alias("phrase")).agg(F.max("a").alias("around"))
    left = scored.join(around, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("around") < F.lit(share) * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score").withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

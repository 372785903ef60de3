"""Toxicity: maximum-scoring passages of token log-odds, calibrated by extreme values."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.tables import ALNUM_WORD, held_out, labelled, settled

#: Labelled rows to learn from, at most (chosen by a hash of the id); they are broadcast.
TRAIN_ROWS = 100_000
#: Entries of the lexicon, at most: those of the largest z.
LEXICON = 50_000
#: Prefix lengths that stand between a word and the whole vocabulary.
PREFIXES = (4, 5, 6, 7)
#: Weight of the Dirichlet prior, in documents; least z of an entry; what a word without
#: an entry costs a passage.
PRIOR, LEAST_Z, DROP = 1.0, 3.5, 0.3
#: A prior share stays this far from 0 and 1, so that no word is certain before it is seen.
LEAST_SHARE = 1e-3
#: Passages are significant if chance gives at most this many as good in a clean text.
SIGNIFICANT = 0.05

PASSAGES = "passages array<struct<first:int,past:int,score:double>>"
_PASSAGE = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32()), ("score", pa.float64())]))


@dataclass(frozen=True)
class ToxicityModel:
    """Lexicon (words, and prefixes ending in ``*``), extreme-value and link parameters."""

    lexicon: dict[str, float]
    rate: float  # lambda: chance passages fall off as exp(-rate * score)
    size: float  # K: starts per word
    middle: float
    slope: float
    lapse: float


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per word and label, summed within the task; handed on when many words are held."""
    find = re.compile(ALNUM_WORD).findall
    counts = (Counter(), Counter())

    def out():
        words = list(counts[0].keys() | counts[1].keys())
        batch = pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], names=["word", "clean", "toxic"]
        )
        counts[0].clear(), counts[1].clear()
        return batch

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[label].update(set(find((text or "").lower())))
        if len(counts[0]) + len(counts[1]) > 200_000:
            yield out()
    yield out()


def _log_odds(toxic: Column, clean: Column, prior: Column, base: float) -> tuple[Column, Column, Column]:
    """Smoothed toxic share, its log-odds against the base share, and its standard error."""
    toxic_part, clean_part = toxic + PRIOR * prior, clean + PRIOR * (1 - prior)
    share = F.least(F.greatest(toxic_part / (toxic_part + clean_part), F.lit(LEAST_SHARE)), F.lit(1 - LEAST_SHARE))
    odds = F.log(toxic_part) - F.log(clean_part) - float(np.log(base / (1 - base)))
    error = F.sqrt(1 / (toxic + PRIOR) + 1 / (clean + PRIOR))
    return share, odds, error


def lexicon(counts: DataFrame) -> dict[str, float]:
    """Token scores from ``word, clean, toxic`` document counts.

    The prior of a word is a Dirichlet one centred on the share of its longest prefix,
    that of a prefix on the next shorter one, that of the shortest on the whole
    vocabulary: inflected and derived forms of a toxic stem are known before they are
    seen often. The score is the log-odds less its standard error.
    """
    total = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    if not total["t"] or not total["c"]:
        return {}
    base = total["t"] / (total["t"] + total["c"])
    shown, above = [], None
    for k in PREFIXES:
        level = (
            counts.where(F.length("word") > k)
            .groupBy(F.substring("word", 1, k).alias("part"))
            .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where("toxic > 0")
        )
        level = _with_prior(level, above, k - 1, base)
        share, odds, error = _log_odds(F.col("toxic"), F.col("clean"), F.col("prior"), base)
        level = level.select("part", share.alias("share"), odds.alias("odds"), error.alias("error"))
        shown.append(level.select(F.concat("part", F.lit("*")).alias("token"), "odds", "error"))
        above = level.select("part", "share") if above is None else above.union(level.select("part", "share"))
    words = counts.where("toxic > 0").select(F.col("word").alias("part"), "toxic", "clean")
    words = _with_prior(words, above, PREFIXES[-1], base)
    _, odds, error = _log_odds(F.col("toxic"), F.col("clean"), F.col("prior"), base)
    entries = words.select(F.col("part").alias("token"), odds.alias("odds"), error.alias("error"))
    for level in shown:
        entries = entries.union(level)
    top = entries.where((F.col("odds") > 1) & (F.col("odds") >= LEAST_Z * F.col("error")))
    top = top.orderBy((F.col("odds") / F.col("error")).desc(), "token").limit(LEXICON)
    return {r["token"]: r["odds"] - r["error"] for r in top.collect()}


def _with_prior(level: DataFrame, above: DataFrame | None, most: int, base: float) -> DataFrame:
    if above is None:
        return level.withColumn("prior", F.lit(min(max(base, LEAST_SHARE), 1 - LEAST_SHARE)))
    parent = F.substring("part", 1, F.least(F.length("part") - 1, F.lit(most)))
    parents = above.select(F.col("part").alias("parent"), F.col("share").alias("prior"))
    return level.withColumn("parent", parent).join(parents, "parent", "left").withColumn("prior", F.coalesce("prior", F.lit(min(max(base, LEAST_SHARE), 1 - LEAST_SHARE)))).drop("parent")


class _Scores(dict):
    """Score by word: its entry, else that of its longest known prefix, else 0; remembers."""

    def __init__(self, entries: dict[str, float]):
        super().__init__({w: s for w, s in entries.items() if not w.endswith("*")})
        self.entries = entries

    def __missing__(self, word: str) -> float:
        score = 0.0
        for k in reversed(PREFIXES):
            if len(word) > k and (found := self.entries.get(word[:k] + "*")) is not None:
                score = found
                break
        if len(self) > 500_000:
            self.clear()
            self.update({w: s for w, s in self.entries.items() if not w.endswith("*")})
        self[word] = score
        return score


def maximal_passages(hits: list[tuple[int, float]], drop: float = DROP) -> list[tuple[int, int, float]]:
    """All maximal scoring passages, in linear time: ``(first word, past last word, score)``.

    ``hits`` are the positive words by position; every word between costs ``drop``. Each
    open passage keeps the running sum before and after it and the nearest earlier one
    that starts lower, so no passage is looked at again after it was joined.
    """
    open_: list[tuple[float, float, int, int, int]] = []  # before, after, first, past, nearest lower
    total, at = 0.0, 0
    for k, score in hits:
        total -= drop * (k - at)
        before, first = total, k
        total += score
        at = k + 1
        j = len(open_) - 1
        while True:
            while j >= 0 and open_[j][0] >= before:
                j = open_[j][4]
            if j < 0 or open_[j][1] >= total:
                open_.append((before, total, first, at, j))
                break
            before, _, first, _, lower = open_[j]
            del open_[j:]
            j = lower
    return [(first, past, after - before) for before, after, first, past, _ in open_]


def _scan(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, scores = re.compile(ALNUM_WORD).findall, _Scores(sent.value)
        for batch in batches:
            sizes, passages = [], []
            for text in batch.column(1).to_pylist():
                words = find(text.lower()) if text else ()
                sizes.append(len(words))
                hits = [x for x in enumerate(map(scores.__getitem__, words)) if x[1]]
                passages.append([{"first": a, "past": b, "score": s} for a, b, s in maximal_passages(hits)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(passages, _PASSAGE)], names=["doc_id", "n_words", "passages"]
            )

    return run


def _best(passages: str = "passages") -> Column:
    return F.coalesce(F.array_max(F.transform(passages, lambda p: p["score"])), F.lit(0.0))


def _fit_extremes(rows: list) -> tuple[float, float]:
    """rate and size from best scores of clean texts, by likelihood over score intervals.

    P(best <= s in n words) = exp(-size * n * exp(-rate * s)); rows hold counts by rounded
    ln(n) and by half units of the score, those without a passage count as at most 1.
    """
    if not rows:
        return 1.0, 1.0
    n = np.exp(np.array([r["ln"] / 4 for r in rows]))
    at = np.array([r["bin"] for r in rows], float)
    weight = np.array([r["n"] for r in rows], float)
    upper, lower = np.where(at <= 2, 1.0, at / 2), np.where(at <= 2, -np.inf, (at - 1) / 2)
    best = (-np.inf, 1.0, 1.0)
    for rate in np.arange(0.2, 4.01, 0.05):
        for size in np.exp(np.arange(-14, 4.01, 0.25)):
            f = np.exp(-size * n * np.exp(-rate * upper)) - np.where(np.isinf(lower), 0.0, np.exp(-size * n * np.exp(-rate * lower)))
            fit = float(weight @ np.log(np.maximum(f, 1e-12)))
            if fit > best[0]:
                best = (fit, float(rate), float(size))
    return best[1], best[2]


def _fit_link(rows: list) -> tuple[float, float, float]:
    """Link of the evidence: ``(middle, slope, lapse)`` of lapse + (0.99 - lapse) * logistic.

    Some texts are labelled toxic without any evidence; the lapse takes their share, so they
    don't flatten the curve where evidence decides. By likelihood over bounded bins.
    """
    if not any(r["label"] for r in rows):
        return 60.0, 1.0, 0.005
    x = np.array([(r["bin"] + 0.5) / 4 for r in rows])
    y = np.array([r["label"] for r in rows], bool)
    weight = np.array([r["n"] for r in rows], float)
    none = x < 1
    lapse = float(np.clip((weight @ (y & none) + 0.1) / (weight @ none + 10), 0.001, 0.2))
    best = (-np.inf, 60.0, 1.0)
    for middle in np.arange(1.0, 60.0, 0.25):
        for slope in (0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8):
            p = lapse + (0.99 - lapse) / (1 + np.exp(-np.clip(slope * (x - middle), -30, 30)))
            fit = float(weight @ np.log(np.where(y, p, 1 - p)))
            if fit > best[0]:
                best = (fit, float(middle), slope)
    return best[1], best[2], lapse


def _evidence(model_rate: float, model_size: float) -> Column:
    """Sum of -ln E over passages that chance gives less than once in a text of this length."""
    chance = lambda p: model_rate * p["score"] - F.log(model_size * F.greatest("n_words", F.lit(1)))
    return F.aggregate("passages", F.lit(0.0), lambda acc, p: acc + F.greatest(F.lit(0.0), chance(p)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row ``doc_id, held_out, score, predicted, n_words, n_significant, passages``.

    Learns from labelled rows outside the held-out fold, at most ``TRAIN_ROWS``. Four
    fifths give document counts of words by label (equal texts once), from which token
    log-odds with Dirichlet priors follow; the last fifth calibrates. Every whole text is
    scanned for all maximal passages. The best score of clean texts gives the
    extreme-value law of chance passages; a text's evidence is the sum of -ln E over its
    passages, and a logistic link turns it into ``score``. ``predicted`` is 1 from 0.7 on.
    ``passages`` hold word ranges (words of ``ALNUM_WORD``, lower-cased), score and E.

    Null and empty texts have no passage and get the least score. Without labels
    of both kinds every text gets the same low score. A null id is held out. Labels of ids
    that repeat in ``docs`` hold for each row. Other columns are ignored.
    """
    scored, model = _learned(docs, labels)
    evidence = _evidence(model.rate, model.size)
    score = model.lapse + (0.99 - model.lapse) / (1 + F.exp(-model.slope * (evidence - model.middle)))
    chance = lambda p: F.exp(F.log(F.lit(model.size) * F.greatest("n_words", F.lit(1))) - model.rate * p["score"])
    passages = F.transform("passages", lambda p: F.struct(p["first"], p["past"], p["score"], chance(p).alias("chance")))
    return (
        scored.select("doc_id", "n_words", score.alias("score"), passages.alias("passages"))
        .withColumn("n_significant", F.size(F.filter("passages", lambda p: p["chance"] <= SIGNIFICANT)).cast("long"))
        .select(
            "doc_id",
            held_out(F.col("doc_id")).alias("held_out"),
            "score",
            F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
            "n_words",
            "n_significant",
            "passages",
        )
    )


def _learned(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, ToxicityModel]:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labelled(labels, "toxic").where(~held_out(F.col("label_id")))
    known = known.join(rows.select(F.col("doc_id").alias("label_id")), "label_id", "left_semi")
    n = known.count()
    if n > TRAIN_ROWS:
        known = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(TRAIN_ROWS / n * (1 << 30)))
    calibrates = F.pmod(F.xxhash64("label_id", F.lit(7)), F.lit(5)) == 0
    known = settled(known.withColumn("calibrates", calibrates), "toxicity-labels")
    learns = F.broadcast(known.where("NOT calibrates"))  # at most TRAIN_ROWS rows of two numbers
    once = (
        rows.join(learns, rows.doc_id == learns.label_id)
        .groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("print"))
        .agg(F.min("label_id").alias("label_id"), F.max("label").alias("label"))
        .select("label_id", "label")
    )
    once = settled(once, "toxicity-texts")
    counts = settled(
        rows.join(F.broadcast(once), rows.doc_id == once.label_id)
        .select("text", "label")
        .mapInArrow(_count, "word string, clean long, toxic long")
        .groupBy("word")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")),
        "toxicity-words",
    )
    entries = lexicon(counts)
    scored = settled(rows.mapInArrow(_scan(spark.sparkContext.broadcast(entries)), f"doc_id long, n_words long, {PASSAGES}"), "toxicity-passages")
    judged = scored.join(F.broadcast(known.where("calibrates")), F.col("doc_id") == F.col("label_id"))
    bins = (
        judged.where("label = 0 AND n_words > 0")
        .groupBy(F.round(4 * F.log("n_words")).cast("int").alias("ln"), F.ceil(2 * _best()).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
        .collect()
    )
    rate, size = _fit_extremes(bins)
    x = F.least(F.floor(4 * _evidence(rate, size)), F.lit(400)).cast("int")
    link = judged.groupBy(x.alias("bin"), "label").agg(F.count("*").alias("n")).collect()
    return scored, ToxicityModel(entries, rate, size, *_fit_link(link))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``toxicity`` does not predict toxic, all columns as they were.

    The model is learned from the same rows and labels; then the rows are judged where they
    are read, without a shuffle, so ids need not be unique.
    """
    _, model = _learned(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.rate, model.size, model.middle, model.slope, model.lapse))
    return docs.mapInArrow(_drop(sent, docs.columns.index("text")), docs.schema)


def _drop(sent, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, rate, size, middle, slope, lapse = sent.value
        find, scores = re.compile(ALNUM_WORD).findall, _Scores(entries)
        for batch in batches:
            keep = []
            for text in batch.column(column).to_pylist():
                words = find(text.lower()) if text else ()
                hits = [x for x in enumerate(map(scores.__getitem__, words)) if x[1]]
                base = np.log(size * max(len(words), 1))
                evidence = sum(max(0.0, rate * s - base) for _, _, s in maximal_passages(hits))
                keep.append(bool(lapse + (0.99 - lapse) / (1 + np.exp(-slope * (evidence - middle))) < 0.7))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run

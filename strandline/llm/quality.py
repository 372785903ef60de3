"""Quality classifier: positive-unlabelled learning with a non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import tokens
from strandline.llm.tables import held_out, labelled, settled

#: Bins of each feature: powers of two of a share, from under 1/1024 up.
BINS = 12
FEATURES = (
    "words", "word bytes", "symbols", "bangs", "capitals", "digits", "stops", "beyond ascii", "line feeds",
    "distinct words", "repeated pairs", "repeated runs", "commonest word", "one-off lines",
)
WIDTH = len(FEATURES) * BINS + 1
RIDGE, ROUNDS = 1e-4, 12

_byte = np.arange(256)
_CLASS = {
    "symbols": np.isin(_byte, list(b"#*$%&|<>")),
    "bangs": _byte == 33,
    "capitals": (_byte >= 65) & (_byte <= 90),
    "digits": (_byte >= 48) & (_byte <= 57),
    "stops": np.isin(_byte, list(b".,;:?")),
    "beyond ascii": _byte >= 192,
    "line feeds": _byte == 10,
}
del _byte


def _share_bin(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    share = part / np.maximum(whole, 1)
    return np.clip(np.floor(np.log2(share * 1024 + 1)), 0, BINS - 1).astype(np.int64)


def _distinct_per_text(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values per text, and how often its commonest one occurs."""
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    if not len(h):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    edge = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
    count = np.diff(np.r_[edge, len(h)])
    most = np.zeros(n, np.int64)
    np.maximum.at(most, text[edge], count)
    return np.bincount(text[edge], minlength=n), most


def features(block: tokens.Block) -> np.ndarray:
    """Bin of every feature of every text of a block (cut without lower-casing)."""
    n = len(block.offset) - 1
    buf = np.frombuffer(block.data, np.uint8)
    size = np.diff(block.offset)
    words = np.diff(block.first)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask, dtype=np.int64)]
        return total[block.offset[1:]] - total[block.offset[:-1]]

    counts = {k: per_text(lut[buf]) for k, lut in _CLASS.items()}
    if len(buf):  # capitals of Latin-1 letters: C3 80 to C3 9E
        latin = np.zeros(len(buf), bool)
        latin[:-1] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
        counts["capitals"] = counts["capitals"] + per_text(latin)
    distinct, most = _distinct_per_text(block.hash, block.doc, n)
    shares = []
    for width in (2, 3):
        grams = tokens.shingles(block.hash, width)
        inside = block.doc[: len(grams)] == block.doc[width - 1 :] if len(grams) else np.zeros(0, bool)
        all_ = np.bincount(block.doc[: len(grams)][inside], minlength=n)
        shares.append((all_ - _distinct_per_text(grams[inside], block.doc[: len(grams)][inside], n)[0], all_))
    letters = np.bincount(block.doc, weights=block.end - block.start, minlength=n)
    cut = tokens.cut_words(block.data, block.offset, _LINE_FEED)
    lines = np.diff(cut.first)
    columns = [
        np.clip(np.floor(np.log2(words + 1)), 0, BINS - 1).astype(np.int64),
        np.clip(letters / np.maximum(words, 1), 0, BINS - 1).astype(np.int64),
        *(_share_bin(counts[k], size) for k in ("symbols", "bangs", "capitals", "digits", "stops", "beyond ascii", "line feeds")),
        np.clip(np.floor(BINS * distinct / np.maximum(words, 1)), 0, BINS - 1).astype(np.int64),
        *(_share_bin(*x) for x in shares),
        _share_bin(most, words),
        _share_bin(lines - _distinct_per_text(cut.hash, cut.doc, n)[0], lines),
    ]
    return np.stack(columns, axis=1).astype(np.int8)


_LINE_FEED = np.arange(256) == 10


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(block) for _, _, block in tokens.blocks(batch.column(1), tokens.SPACE, lower=False)]
        bins = np.concatenate(found) if found else np.zeros((0, len(FEATURES)), np.int8)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r.tobytes() for r in bins], pa.binary())], names=["doc_id", "bins"]
        )


def _design(bins: pa.Array) -> np.ndarray:
    """One column per feature and bin, and a constant."""
    raw = np.frombuffer(b"".join(bins.to_pylist()), np.int8).reshape(-1, len(FEATURES)).astype(np.int64)
    x = np.zeros((len(raw), WIDTH))
    np.put_along_axis(x, raw + BINS * np.arange(len(FEATURES)), 1.0, axis=1)
    x[:, -1] = 1.0
    return x


def _softplus(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, g)


def _sums(w: np.ndarray):
    """This task's part of risk, gradient and curvature over unlabelled rows, and of the positives'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 + 2 * WIDTH + WIDTH * WIDTH)
        for batch in batches:
            x, positive = _design(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            g = x @ w
            p = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
            total[:4] += len(g), _softplus(g).sum(), positive.sum(), _softplus(g[positive]).sum()
            total[4 : 4 + WIDTH] += x.T @ p
            total[4 + WIDTH : 4 + 2 * WIDTH] += x[positive].sum(axis=0)
            total[4 + 2 * WIDTH :] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["at", "part"])

    return run


def _collected(table: DataFrame, w: np.ndarray) -> np.ndarray:
    rows = table.select("positive", "bins").mapInArrow(_sums(w), "at int, part double")
    found = rows.groupBy("at").agg(F.sum("part").alias("part")).toArrow()
    out = np.zeros(4 + 2 * WIDTH + WIDTH * WIDTH)
    out[found.column("at").to_numpy()] = found.column("part").to_numpy()
    return out


def fit(table: DataFrame, prior: float) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk over ``positive, bins`` rows.

    All rows are the unlabelled sample. With the logistic loss l, the risk
    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) has a convex inside, so
    Newton steps are used; each round is one pass whose sums are all that leaves the
    tasks. A step after which the negative part is below zero (the sign of overfitting
    that the correction stands against) is taken back by half.
    """
    w, last = np.zeros(WIDTH), None
    w[-1] = np.log(prior / (1 - prior))
    for _ in range(ROUNDS):
        s = _collected(table, w)
        n, risk_u, n_p, risk_p = s[:4]
        if not n or not n_p:
            return w
        if last is not None and risk_u / n - prior * risk_p / n_p < 0:
            w = (w + last) / 2
            continue
        gradient = s[4 : 4 + WIDTH] / n - prior * s[4 + WIDTH : 4 + 2 * WIDTH] / n_p + RIDGE * w
        curvature = s[4 + 2 * WIDTH :].reshape(WIDTH, WIDTH) / n + RIDGE * np.eye(WIDTH)
        step = np.clip(np.linalg.solve(curvature, gradient), -2, 2)
        last, w = w, w - step
        if np.abs(step).max() < 1e-3:
            break
    return w


def _score(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(_design(batch.column(1)) @ w, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row ``doc_id, held_out, score, predicted``: how likely a text has label 1.

    Trusted positives are the rows labelled 1 outside the held-out fold, the unlabelled
    sample is all texts, and the class prior is the share of 1 among the labels outside
    the held-out fold (kept within 0.02 and 0.98). Features are shapes of the whole
    text, in bins: sizes, shares of kinds of characters, repeated words, runs and lines;
    no id, language, source or label enters a score.

    Null and empty texts are scored as texts without words. Without positives every
    score is the prior (0.5 without labels). A null id is held out. Labels of an id that
    repeats hold for each row. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labelled(labels, "quality").where(~held_out(F.col("label_id")))
    share = known.agg(F.avg("label").alias("p")).first()["p"]
    prior = min(0.98, max(0.02, 0.5 if share is None else share))
    described = rows.mapInArrow(_describe, "doc_id long, bins binary")
    positives = known.where("label = 1").select("label_id")
    described = settled(described, "quality-features")
    table = settled(
        described.join(positives, F.col("doc_id") == F.col("label_id"), "left")
        .select("doc_id", F.col("label_id").isNotNull().alias("positive"), "bins"),
        "quality-table",
    )
    w = fit(table, prior)
    return (
        table.select("doc_id", "bins")
        .mapInArrow(_score(w), "doc_id long, score double")
        .select(
            "doc_id",
            held_out(F.col("doc_id")).alias("held_out"),
            "score",
            F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        )
    )

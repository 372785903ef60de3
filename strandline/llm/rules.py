"""Quality rules with adaptive thresholds from mergeable quantile sketches. Native expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.tables import plain_words, settled

#: Metrics in whole numbers: thousandths of a letter, or millionths of a share. A share names
#: the count it is of and what that count is out of.
METRICS = {
    "word_length": None,
    "symbol_share": ("n_symbols", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
}
#: Per cent of the quantiles ``a, b, c, d`` and the reach of fences ``a - reach * (b - a)`` and
#: ``d + reach * (d - c)``. The first fences say which texts a metric's sketch may learn from. The
#: last ones follow the tails: from 90 to 95 per cent half of the texts above go, so twelve such
#: steps further an exponential tail of that slope has one text in 80,000 left.
FIRST, LAST = (25, 75, 25, 75, 3), (5, 10, 90, 95, 12)
#: A count is beyond its fence if it exceeds what the fence share lets expect by this many
#: standard deviations of a rare event's count, and its square.
CHANCE = 3
#: Cells with fewer texts use their language's sketch, languages with fewer the sketch of all.
CELL_TEXTS = 200

_BLANK = " \t\n\x0b\x0c\r"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def counts(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the base counts of whole texts, all as long.

    ``n_repeat_words`` counts the words that lie in a three-word window found at least
    twice. Windows are compared by 64-bit hash; only texts in which two agree are sorted
    (n log n), and places are counted from the sorted starts, so no window is looked up
    in a list.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("t")
    ).withColumn("words", plain_words(F.col("t")))
    last = F.size("words") - 3
    windows = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    used = F.filter(F.split("t", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("windows", windows).withColumn("lines", F.transform(used, lambda line: F.xxhash64(line)))
    n_lines = F.size("lines")
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(_without(F.col("t"), _BLANK)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), "#*$%&|<>"))).cast("long").alias("n_symbols"),
        n_lines.cast("long").alias("n_lines"),
        (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows"))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("windows"),
    )
    sorted_ = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    rows = rows.withColumn("sorted", sorted_)
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    again = F.filter("sorted", lambda x, i: same(x, F.get("sorted", i + 1)) | ((i > 0) & same(x, F.get("sorted", i - 1))))
    rows = rows.withColumn("starts", F.sort_array(F.transform(again, lambda x: x["at"])))
    covered = F.transform("starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - p, F.lit(3))))
    return rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.aggregate(covered, F.lit(0).cast("long"), lambda acc, n: acc + n).alias("n_repeat_words"),
    )


def bucket(value: Column) -> Column:
    """Bucket of a whole number: exact below 512, then 256 to each doubling (at most 1/256 wide)."""
    bits = F.length(F.bin(value)) - 9
    return F.when(value < 512, value).otherwise(bits * 256 + F.call_function("shiftright", value, bits)).cast("long")


def _bucket_bounds(b: Column) -> tuple[Column, Column]:
    """Smallest and largest number of a bucket."""
    e = F.when(b < 512, F.lit(0)).otherwise(F.floor(b / 256) - 1).cast("int")
    m = b - e * 256
    low = F.call_function("shiftleft", m, e)
    return low, F.call_function("shiftleft", m + 1, e) - 1


def metrics(found: DataFrame) -> DataFrame:
    """Whole-number metrics of the counts, zero where the divisor is."""
    share = lambda part, whole, unit: F.expr(f"coalesce(try_divide({part} * {unit}L, {whole}), 0)").cast("long")
    return (
        found.withColumn("word_length", share("word_chars", "n_words", 1_000))
        .withColumn("symbol_share", share("n_symbols", "word_chars", 1_000_000))
        .withColumn("repeat_share", share("n_repeat_words", "n_words", 1_000_000))
        .withColumn("dup_line_share", share("n_dup_lines", "n_lines", 1_000_000))
    )


def sketches(measured: DataFrame, learns: dict[str, Column]) -> DataFrame:
    """``lang, source, metric, bucket, n``: a quantile sketch per cell, merged by adding up.

    Only texts that pass the base rules count, and of those the ones for which ``learns`` of the
    metric holds. Values within a bucket differ by 1/256 at most, which bounds the relative
    error of every quantile; a sketch has a bounded number of buckets whatever the number of
    texts, and sums of sketches are sketches.
    """
    each = F.array(*[F.when(learns[m], F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket"))) for m in METRICS])
    return (
        measured.where("NOT base_failed")
        .select("lang", "source", F.explode(each).alias("m"))
        .where("m IS NOT NULL")
        .groupBy("lang", "source", "m.metric", "m.bucket")
        .agg(F.count("*").alias("n"))
    )


def thresholds(cells: DataFrame, names: DataFrame, tails: tuple[int, int, int, int, int]) -> DataFrame:
    """``lang, source`` and per metric ``<metric>_low``, ``<metric>_high`` for every cell in ``names``.

    Null where not even the sketch of all has a text.
    """
    of_lang = cells.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    of_all = of_lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    levels = (
        cells.select(F.lit(0).alias("level"), "lang", "source", "metric", "bucket", "n")
        .union(of_lang.select(F.lit(1), "lang", F.lit(None).cast("string"), "metric", "bucket", "n"))
        .union(of_all.select(F.lit(2), F.lit(None).cast("string"), F.lit(None).cast("string"), "metric", "bucket", "n"))
    )
    sketch = Window.partitionBy("level", "lang", "source", "metric")
    upto = F.sum("n").over(sketch.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    placed = levels.select("*", upto.alias("upto"), F.sum("n").over(sketch).alias("total"))
    low, high = _bucket_bounds(F.col("bucket"))
    quantile = lambda percent, bound: F.min(F.when(F.col("upto") * 100 >= F.col("total") * percent, bound))
    a, b, c, d, reach = tails
    quantiles = placed.groupBy("level", "lang", "source", "metric").agg(
        F.max("total").alias("total"),
        quantile(a, low).alias("a"), quantile(b, low).alias("b"), quantile(c, high).alias("c"), quantile(d, high).alias("d"),
    )
    fences = quantiles.select(
        "level", "lang", "source", "metric", "total",
        (F.col("a") - reach * (F.col("b") - F.col("a"))).alias("low"), (F.col("d") + reach * (F.col("d") - F.col("c"))).alias("high"),
    )
    pick = lambda level: fences.where(F.col("level") == level)
    own, lang, every = pick(0).alias("a"), pick(1).alias("b"), pick(2).alias("c")
    same = lambda x, *columns: F.expr(" AND ".join(f"n.{c} <=> {x}.{c}" for c in columns))
    found = (
        names.select("lang", "source", "metric").distinct().alias("n")
        .join(own, same("a", "lang", "source", "metric"), "left")
        .join(lang, same("b", "lang", "metric"), "left")
        .join(every, same("c", "metric"), "left")
        .select("n.lang", "n.source", "n.metric", *[
            F.when(F.col("a.total") >= CELL_TEXTS, F.col(f"a.{x}")).when(F.col("b.total") >= CELL_TEXTS, F.col(f"b.{x}"))
            .otherwise(F.col(f"c.{x}")).alias(x)
            for x in ("low", "high")
        ])
    )
    wide = []
    for m in METRICS:
        for x in ("low", "high"):
            wide.append(F.max(F.when(F.col("metric") == m, F.col(x))).alias(f"{m}_{x}"))
    return found.groupBy("lang", "source").agg(*wide)


def _fenced(measured: DataFrame, fences: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with the fences of their cell, and per metric whether a row lies within them."""
    m, t = measured.alias("m"), fences.alias("t")
    rows = m.join(t, F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source")), "left")
    inside = {}
    for name, share in METRICS.items():
        if share is None:
            within = (F.col(name) >= F.col(f"{name}_low")) & (F.col(name) <= F.col(f"{name}_high"))
        else:
            expected = (F.col(share[1]) * F.col(f"{name}_high")).cast("double") / 1_000_000.0
            within = F.col(share[0]).cast("double") <= expected + CHANCE * F.sqrt(expected) + CHANCE * CHANCE
        inside[name] = F.coalesce(within, F.lit(True))
    return rows.select("m.*", *[within.alias(f"{name}_in") for name, within in inside.items()]), {m: F.col(f"{m}_in") for m in METRICS}


def _all_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Verdict per row: ``doc_id``, base counts, ``base_failed``, ``kept``, metrics.

    Base rules: at least 50 words, and at most half of them in repeated three-word
    windows. Texts that pass give quantile sketches per language and source, in two rounds.
    The quartiles of the first give wide fences (``FIRST``). The second sketch of a metric
    holds the texts that no *other* metric has outside them, so that junk, which is odd in
    several ways, is not what the fences are learned from, while a metric's own tail is. Its
    outer quantiles give the fences by which texts are kept (``LAST``). A share's fence
    is a number of events to expect in a text of this length, and chance may add ``CHANCE``
    deviations; word length has a lower fence too. Up to a quarter of a cell may be junk in
    one metric, and up to a twentieth in a metric without being odd in another.

    Null text counts as empty and fails; null language and source are cells like others;
    repeated rows are judged each. Other columns are ignored.
    """
    found = counts(docs)
    measured = metrics(found).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )
    measured = settled(measured, "quality-counts")
    cells = settled(sketches(measured, {m: F.lit(True) for m in METRICS}), "quality-sketch")
    rows, inside = _fenced(measured, settled(thresholds(cells, cells, FIRST), "quality-first"))
    others = {m: _all_of([within for name, within in inside.items() if name != m]) for m in METRICS}
    learned = settled(sketches(rows, others), "quality-trusted")
    rows, inside = _fenced(measured, settled(thresholds(learned, cells, LAST), "quality-fences"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & _all_of(list(inside.values()))).alias("kept"),
        *METRICS,
    )

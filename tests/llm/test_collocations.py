"""Phrase collocations against counting every phrase one by one, and the corners of the contract."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import collocations


def by_hand(rows, least, longest, top, share=100):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    cands = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = {}
    for (lang, p), a in cands.items():
        inside = any(x == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in cands.items())
        if not inside:
            cuts = [(1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], total[lang]))
    return sorted(
        (lang, n + 1, p.decode(), -a, left, rest, whole, -s)
        for lang, found in out.items()
        for n, (s, a, p, left, rest, whole) in enumerate(sorted(found)[:top])
    )


def texts(seed, n):
    rng = random.Random(seed)
    fixed = ["New York city", "as far as I know", "a a a a", "é ü", "z z", "x\ty z"]
    for _ in range(n):
        words = [rng.choice([*(chr(97 + k) for k in range(9)), *fixed, ".", "x, y", "!?", "q\nr", "s\x0bt\x0c"]) for _ in range(rng.randrange(40))]
        yield rng.choice(["en", "de", None, "und", ""]), rng.choice([" ", "  ", "\t"]).join(words)


@pytest.mark.parametrize("least, longest, top, share", [(5, 5, 2000, 100), (3, 3, 7, 80), (12, 5, 4, 100), (300, 5, 9, 100)])
def test_by_counting_every_phrase(spark, least, longest, top, share):
    rows = [*texts(least, 250), (None, None), ("en", None), ("de", ""), ("de", " \t "), *[("en", "Echo Foxtrot golf")] * 20]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for name in ("n", "words", "w1", "rank", "left_out", "slice"):
        docs = docs.withColumn(name, F.lit(1))
    found = sorted(tuple(r) for r in collocations.collocations(docs, least, longest, top, share).collect())
    assert found == by_hand(rows, least, longest, top, share) and (least > 12 or found)


def test_counters_that_overflow_their_table_change_nothing(spark, monkeypatch):
    rows = [*texts(4, 250)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    expected = by_hand(rows, 5, 5, 2000)
    for name, value in (("SMALLEST", 16), ("LARGEST", 16), ("SLICE", 1 << 10), ("WORDS", 50), ("HELD", 200)):
        monkeypatch.setattr(collocations, name, value)
    assert sorted(tuple(r) for r in collocations.collocations(docs, 5).collect()) == expected
    full = spark.sparkContext.broadcast(np.full(1 << 13, 255, np.uint8))
    monkeypatch.setattr(collocations, "_frequent", lambda texts, least, longest: [(full, 16)] * 2)
    assert sorted(tuple(r) for r in collocations.collocations(docs, 5).collect()) == expected


def test_odd_documents(odd_docs, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    rows = collocations.collocations(odd_docs, least=4).collect()
    assert {r.lang for r in rows} == {"en"} and {r.n for r in rows} == {60_000 + 15 * 5 + 1 + 2 + 1 + 15}
    assert collocations.collocations(odd_docs).where("a > 1000").count() == 0


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([(3 * 10**13, 9 * 10**13, 4 * 10**13, 5 * 10**13)], "a long, total long, l long, r long")
    big = lambda name: F.col(name).cast("decimal(18,0)")
    product = counts.withColumn("product", F.lit(1000).cast("decimal(4,0)") * (big("a") * big("total")))
    score = product.selectExpr("product div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0))) AS s").first().s
    assert score == 1000 * 3 * 10**13 * 9 * 10**13 // (4 * 10**13 * 5 * 10**13)


def test_windows_are_counted_in_large_tasks(spark):
    # small tasks each pass on nearly every frequent phrase
    texts = spark.range(400).selectExpr("'en' AS lang", "'a b c' AS text").repartition(200)
    least = 2 * spark.sparkContext.defaultParallelism
    assert collocations._in_large_tasks(texts, 1200).rdd.getNumPartitions() == min(200, least)
    assert collocations._in_large_tasks(texts, 150 * collocations.TASK_BYTES).rdd.getNumPartitions() == max(150, min(200, least))

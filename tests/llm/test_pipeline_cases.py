"""The whole pipeline on planted cases, on nulls and clashing names, and on empty tables."""

import random

import corpus_pipeline


def _words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n)]


def _wrapped(words, width):
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def _tables(spark, folder, docs, labels, benchmark):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_planted_cases(spark, tmp_path):
    rng = random.Random(4)
    a, b, c, d, item = (_words(rng, n) for n in (60, 120, 60, 40, 20))
    texts = [
        (1, _wrapped(a, 15)),
        (2, _wrapped(a, 15)),  # every line repeats: empty, so nothing of it is taken
        (3, " ".join(c[:30] + item + c[30:])),  # contaminated
        (4, None),
        (5, _wrapped(b, 20)),
        (6, _wrapped(b, 12)),  # no line repeats, but all shingles do
        (None, " ".join(d)),
    ]
    rows = [(k, t, "en", "a", len(t or "")) for k, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = _tables(spark, tmp_path / "t", docs, [(1, 1, 0), (5, 1, 0)], [("x", " ".join(item)), (None, None)])
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(found) == {1, 5, None}
    assert {k: r["size"] for k, r in found.items()} == {1: 60, 5: 120, None: 40}
    assert all(r["size"] <= r.taken <= 2 * r["size"] for r in found.values())


def test_odd_rows_and_clashing_names(spark, odd_docs, tmp_path):
    folder = _tables(spark, tmp_path / "t", odd_docs, [(1, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None)], [(None, "one"), ("", "")])
    found = corpus_pipeline.run(spark, folder).collect()
    assert found and all(0 < r.taken <= 2 * r["size"] for r in found)
    assert {r.doc_id for r in found} <= {1, 2, 3, 7, 10, 11, 12, None}


def test_empty_tables(spark, no_docs, tmp_path):
    folder = _tables(spark, tmp_path / "t", no_docs, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0

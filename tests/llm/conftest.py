import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long_text = " ".join(f"word{k % 977}" for k in range(60_000))
    same = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    rows = [
        (1, same, "en", "a", 1), (2, same, "en", "a", 2), (3, same + " pi", "en", None, 3),
        (4, None, None, None, None), (5, "", "en", "b", 5), (6, " \n\t ", "en", "b", 6),
        (7, long_text, "en", "b", 7), (8, "one", "en", "a", 8), (9, "one", "en", "a", 9),
        (None, same, "en", "a", 10), (10, "x" * 300_000, "en", "b", 11), (11, "Straße ÉÈ  0 1\n\n" + same, "de", "c", 12),
        (12, same, "en", "a", 13), (12, same, "en", "a", 13),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    for name in ("_gone", "gone", "c0", "of", "print", "label", "component", "key", "bin", "slice", "done"):
        frame = frame.withColumn(name, frame.n_chars)
    return frame


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None), (7, 0, 1), (7, 1, 0), (99, 1, 1)],
        "doc_id long, quality int, toxic int",
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

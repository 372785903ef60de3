"""Fences follow the texts of their own cell and are not learned from junk."""

from strandline.llm import rules


def _text(n, k, symbols=0, letters=4):
    """``n`` words without a repeated window; ``symbols`` of them are marks, the others have 2 to 2 * letters - 2 letters."""
    words = ["#$%" if i < symbols else f"{k % 10}{i:0{letters - 1}d}"[: 2 + (i * 7 + k) % (2 * letters - 3)] for i in range(n)]
    return " ".join(words)


def test_cells_get_their_own_cutoffs(spark):
    rows = []
    for k in range(300):
        rows.append((k, _text(200, k), "en", "prose"))
        rows.append((1_000 + k, _text(200, k, symbols=5 + k % 20), "en", "code"))
    rows.append((5_000, _text(200, 3, symbols=30), "en", "prose"))
    rows.append((5_001, _text(200, 3, symbols=30), "en", "code"))
    rows.append((5_002, _text(200, 3, symbols=190), "en", "code"))
    rows.append((5_003, _text(200, 3, symbols=2), "en", "prose"))  # what chance allows
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in rules.quality_rules(docs).collect()}
    assert not kept[5_000] and kept[5_001] and not kept[5_002] and kept[5_003]
    assert all(kept[k] for k in range(300)) and all(kept[1_000 + k] for k in range(300))


def test_junk_does_not_move_the_cutoff(spark):
    """An eighth of the texts, odd in symbols and word length, stays out of the sketches of both."""
    clean = [(k, _text(120, k), "en", "web") for k in range(350)]
    junk = [(1_000 + k, " ".join(["#$%&*#$%&*longword" + str(i) for i in range(60 + k % 9)]), "en", "web") for k in range(50)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in rules.quality_rules(docs).where("kept").collect()} == {r[0] for r in clean}


def test_small_cells_use_their_language(spark):
    """Three texts of a cell cannot make its fences; a language of three uses the sketch of all."""
    rows = [(k, _text(120, k), "en", "web") for k in range(300)]
    rows += [(1_000 + k, _text(120, k, symbols=60), "en", None) for k in range(3)]
    rows += [(2_000 + k, _text(120, k, symbols=60), None, "web") for k in range(3)] + [(2_010, _text(120, 1), None, "web")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in rules.quality_rules(docs).collect()}
    assert not any(kept[k] for k in (1_000, 1_001, 1_002, 2_000, 2_001, 2_002)) and kept[2_010]

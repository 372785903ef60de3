"""Periodic runs: brute force over all periods, odd inputs, the transform itself."""

import hashlib
import random

import numpy as np
import pytest

from strandline.llm import periodic


def all_runs(x):
    """Every stretch that a period can't extend, under its smallest period."""
    out = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        words, kinds, size = [], rng.choice([1, 2, 3, 8, 100]), rng.choice([30, 100, 400])
        while len(words) < size:
            piece = [rng.randrange(kinds) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 20, 31, 33, 50]))]
            times = rng.randrange(1, 8) if rng.random() < 0.6 else 1
            words += (piece * times)[: len(piece) * times - rng.randrange(len(piece))]
        yield words


def test_runs_by_brute_force():
    found = 0
    for x in texts(5, 300):
        runs = periodic.find_runs(np.array(x))
        assert runs == all_runs(x)
        found += len(runs)
    assert found > 100


def test_long_repeats_stay_near_linear():
    n = 200_000
    assert periodic.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periodic.find_runs(np.arange(n) % 2) == [(0, n, 2)]
    assert periodic.find_runs(np.arange(n) % 50_001) == [(0, n, 50_001)]


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, periodic.PRIME, (3, 16)).astype(np.uint64) for _ in range(2))
    assert (periodic.back(periodic.transform(a)) == a).all()
    product = periodic.back(periodic.transform(a) * periodic.transform(b) % np.uint64(periodic.PRIME))
    for r in range(3):
        for k in range(16):
            exact = sum(int(a[r, i]) * int(b[r, (k - i) % 16]) for i in range(16)) % periodic.PRIME
            assert int(product[r, k]) == exact


def test_other_bounds_are_refused():
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(50, np.int64), least=10)


def test_rows_and_collapsed_texts(spark):
    rows = [(k, " ".join(f"w{w}" for w in x)) for k, x in enumerate(texts(9, 60))]
    got = {r.doc_id: r for r in periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        words, r = text.split(), got[k]
        runs = all_runs(words)
        assert [(x.start, x.length, x.period) for x in r.runs] == runs and r.n_runs == len(runs)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        if runs:
            s, n, q = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = periodic.periodic_runs(odd_docs, plant=True).collect()
    assert len(rows) == odd_docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    for r in rows:
        if r.doc_id in (4, 5, 6):
            assert (r.n_runs, r.start, r.collapsed, r.runs_sha256, r.collapsed_sha256) == (0, None, "", empty, empty)
    assert periodic.periodic_runs(no_docs).count() == 0
    long_text = next(r for r in periodic.periodic_runs(odd_docs).collect() if r.doc_id == 7)
    assert [(x.start, x.length, x.period) for x in long_text.runs] == [(0, 60_000, 977)]
    left = periodic.without_repeats(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count()
    texts_left = {r.n_chars: r.text for r in left.collect()}
    assert len(texts_left[7].split()) == 977 and texts_left[None] is None and texts_left[6] == " \n\t "
    assert periodic.without_repeats(no_docs).count() == 0

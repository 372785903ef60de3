"""Every notice of a text is reported, by a join that compares whole word sets."""

import random

from strandline.llm import licenses

FILL = [f"filler{k}" for k in range(50)]


def _filler(rng, n):
    return " ".join(rng.choice(FILL) for _ in range(n))


def test_two_notices_are_two_blocks(spark):
    rng = random.Random(5)
    mit, bsd = licenses.TEMPLATES[1][1], licenses.TEMPLATES[3][1]
    text = f"{mit} {_filler(rng, 80)} {mit}\n{_filler(rng, 50)} {bsd} {_filler(rng, 60)} {mit}"
    docs = spark.createDataFrame([(1, text), (2, _filler(rng, 300)), (3, None), (1, mit)], "doc_id long, text string")
    second = len(mit.split()) + 80
    third = second + len(mit.split()) + 50 + len(bsd.split()) + 60
    rows = sorted((r.doc_id, r.label, r["at"], r.share) for r in licenses.license_blocks(docs).collect())
    assert rows == [
        (1, "bsd", second + len(mit.split()) + 50, 1.0), (1, "mit", 0, 1.0), (1, "mit", 0, 1.0),
        (1, "mit", second, 1.0), (1, "mit", third, 1.0),
    ]
    assert sorted(r.n_notices for r in licenses.license_scan(docs).collect()) == [0, 0, 1, 4]


def test_blocks_by_brute_force(spark):
    """Random templates and texts of few words: the same texts and shares as by looking at every block."""
    rng = random.Random(11)
    words = [f"t{k}" for k in range(14)]
    templates = tuple((f"l{k}", " ".join(rng.sample(words, rng.randint(2, 9)))) for k in range(8))
    texts = [" ".join(rng.choice(words + FILL[:12]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in licenses.license_blocks(docs, templates).collect():
        found[r.doc_id, r.label] = max(found.get((r.doc_id, r.label), 0), r.share)
    expected = {}
    for k, text in enumerate(texts):
        w = text.split()
        for label, body in templates:
            t = set(body.split())
            n = max((len(set(w[i : i + licenses.SPREAD * len(body.split())]) & t) for i in range(len(w))), default=0)
            if 100 * n >= licenses.CONTAINED * len(t):
                expected[k, label] = n / len(t)
    assert found == expected and expected


def test_a_text_of_notices_stays_small(spark):
    """A notice repeated 3,000 times: one block per width, all of them verified."""
    mit = licenses.TEMPLATES[1][1]
    docs = spark.createDataFrame([(1, f"{mit} " * 3_000)], "doc_id long, text string")
    blocks = licenses.license_blocks(docs)
    assert 500 <= blocks.where("label = 'mit' AND share = 1").count() <= 3_000

"""Odd inputs and brute force for every operator of the corpus folder."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import (
    components,
    decontaminate,
    licenses,
    line_dedup,
    mixing,
    near_duplicates,
    quality,
    quotations,
    rules,
    tokens,
    toxicity,
    warc,
)

WORDS = [f"w{k}" for k in range(40)]


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(text):
    return re.findall("[^\x20\x09-\x0d]+", lowered(text))


def test_words_keep_to_their_text():
    texts = ["ab c", None, "", "d", "é\x0bf"]
    got = []
    for i, j, block in tokens.blocks(pa.array(texts), tokens.SPACE, target=4):
        got += [[block.word(k).decode() for k in range(block.first[t], block.first[t + 1])] for t in range(j - i)]
    assert got == [["ab", "c"], [], [], ["d"], ["é", "f"]]


def test_equal_words_share_a_hash_and_others_do_not():
    words = [f"{a}{b}" for a in "abcé" for b in range(500)]
    (_, _, block), = tokens.blocks(pa.array([" ".join(words + words)]), tokens.SPACE, target=1 << 30)
    h = block.hash
    assert (h[: len(words)] == h[len(words) :]).all() and len(set(h.tolist())) == len(words)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)] + [(7, 7)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    rows = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert {r.id: r.component for r in rows} == {x: find(x) for x in linked} and len(rows) == len(linked)


def random_texts(seed, n):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS) + "!"
        else:
            words = [rng.choice(WORDS) for _ in range(rng.randrange(1, 60))]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_by_brute_force(spark, width):
    texts = random_texts(width, 150)
    shingles = {}
    for k, t in enumerate(texts):
        w = plain(t)
        shingles[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    best = dict.fromkeys(shingles)
    group = {k: k for k in shingles}
    find = lambda x: x if group[x] == x else find(group[x])
    for a, b in combinations(shingles, 2):
        common = len(shingles[a] & shingles[b])
        if 100 * common >= 80 * (len(shingles[a]) + len(shingles[b]) - common):
            x, y = find(a), find(b)
            group[max(x, y)] = min(x, y)
    rows = near_duplicates.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width).collect()
    assert len(best) == len(rows)
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in rows} == {k: (find(k), len(s)) for k, s in shingles.items()}


def test_near_duplicates_odd(odd_docs, no_docs):
    rows = by_id(near_duplicates.near_duplicates(odd_docs, 2).collect())
    assert [r.component_id for k in (1, 2, 3, 12) for r in rows[k]] == [1] * 5
    assert rows[8][0].component_id == rows[9][0].component_id == 8
    assert all(rows[k][0].kept and rows[k][0].n_shingles == 0 for k in (4, 5, 6))
    assert rows[None][0].kept and rows[None][0].component_id is None
    assert near_duplicates.near_duplicates(no_docs).count() == 0
    left = near_duplicates.without_near_duplicates(odd_docs, 2)
    assert left.columns == odd_docs.columns and {r.doc_id for r in left.collect()} == {1, 4, 5, 6, 7, 8, 10, 11, None}


def test_repeated_lines_by_brute_force(spark):
    texts = ["\n".join(random_texts(50 + k, 6)) for k in range(25)]
    seen, expected = [], {}
    for k, t in enumerate(texts):
        for n, line in enumerate(t.split("\n")):
            s = set(plain(line))
            if not s:
                continue
            if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                expected.setdefault(k, []).append(n)
            seen.append(s)
    rows = line_dedup.line_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed for r in rows if r.removed} == expected and expected


def test_short_lines_repeat_too(spark):
    rng = random.Random(4)
    short = [" ".join(rng.choice(WORDS[:7]) for _ in range(rng.randrange(8))) for _ in range(300)]
    short += ["a b c d e", "d c b a", "a a b", "b A", "les.", "les.", "Les. les.", " ", "", "a b " * 50, "x y z u", "u x y z v"]
    texts = ["\n".join(short[k : k + 12]) for k in range(0, len(short), 12)]
    seen, expected = [], {}
    for k, t in enumerate(texts):
        for n, line in enumerate(t.split("\n")):
            s = set(plain(line))
            if s and any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                expected.setdefault(k, []).append(n)
            seen.append(s)
    rows = line_dedup.line_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed for r in rows if r.removed} == expected
    assert {1, 3, 5, 6, 9, 11} <= set(expected[len(texts) - 1]) and not {7, 8} & set(expected[len(texts) - 1])


def test_repeated_lines_odd(odd_docs, no_docs):
    rows = by_id(line_dedup.line_report(odd_docs).collect())
    assert (rows[1][0].n_removed, rows[2][0].removed, rows[11][0].removed) == (0, [0], [2])
    assert rows[4][0].n_lines == 0 and rows[5][0].n_lines == 1 and rows[None][0].n_removed == 0
    assert line_dedup.line_report(no_docs).count() == 0
    cut = line_dedup.without_repeated_lines(odd_docs)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == odd_docs.columns and texts[2] == "" and texts[4] is None and texts[11].endswith("1\n")


def test_word_counts_travel_in_small_batches():
    batch = pa.record_batch([pa.array([1]), pa.array([" ".join(f"w{k}" for k in range(50_000))])], names=["doc_id", "text"])
    counts = [len(c) for b in line_dedup._read(iter([batch])) for c in b.column(4).to_pylist() if c]
    assert counts and max(counts) * 10_000 <= 16 << 20
    rows = pa.record_batch([pa.array([3, 3], pa.int32()), pa.array([np.full(4, k, np.int32).tobytes() for k in (1, 0x7FFFFFFF)])], names=["slice", "counts"])
    (summed,) = line_dedup._added(iter([rows]))
    assert np.frombuffer(summed.column(1)[0].as_py(), np.int64).tolist() == [1 << 31] * 4


def test_lines_of_a_word_meet_by_size_in_batches_of_any_length():
    rng = np.random.default_rng(5)
    n, num, den = 400, 80, 100
    word, size = rng.integers(-3, 3, n), rng.integers(5, 60, n)
    order = np.argsort((word << 32) | size, kind="stable")
    word, size = word[order], size[order]
    at = rng.integers(0, size // 5 + 1)
    doc, line, done = rng.integers(0, 40, n), rng.integers(0, 9, n).astype(np.int32), rng.random(n) < 0.5
    parity, parity2 = (rng.integers(-(1 << 63), 1 << 63, n, np.int64) & 0x1F0F for _ in range(2))
    bits = lambda a: bin(int(a) & (2**64 - 1)).count("1")
    expected = set()
    for x in range(n):
        for y in range(n):
            near = min(size[x], size[y]) * den >= max(size[x], size[y]) * num and word[x] == word[y]
            if not near or done[x] or (doc[y], line[y]) >= (doc[x], line[x]):
                continue
            apart = bits(parity[x] ^ parity[y]) + bits(parity2[x] ^ parity2[y])
            overlap = -(-(size[x] + size[y]) * num // (num + den))
            if min(size[x] - at[x], size[y] - at[y]) >= overlap and apart * (den + num) <= (size[x] + size[y]) * (den - num):
                expected.add((doc[x], line[x], doc[y], line[y]))
    names = ["key", "doc_id", "line_no", "at", "parity", "parity2", "done"]
    table = pa.table(dict(zip(names, ((word << 32) | size, doc, line, at.astype(np.int32), parity, parity2, done))))
    for length in (1, 7, n):
        got = [tuple(r.values()) for b in line_dedup._close_pairs(num, den)(iter(table.to_batches(length))) for r in b.to_pylist()]
        assert expected and set(got) == expected


def test_rows_of_a_key_meet_its_first_in_batches_of_any_length():
    rng = np.random.default_rng(6)
    n, num, den = 300, 80, 100
    rows = sorted(zip(*(rng.integers(0, top, n).tolist() for top in (40, 9, 4))))
    expected = []
    for key, doc, line in rows:
        first = next(r for r in rows if r[0] == key)
        if (doc, line) != first[1:]:
            expected.append((doc, line, *first[1:]))
    key, doc, line = (np.array(c, np.int64) for c in zip(*rows))
    zero = np.zeros(n, np.int64)
    lines = pa.table({"key": key, "doc_id": doc, "line_no": line.astype(np.int32)})
    drawn = pa.table({"key": key, "doc_id": doc, "spot": (line << 32) | 10, "parity": zero, "parity2": zero})
    for length in (1, 7, n):
        later = [tuple(r.values()) for b in line_dedup._later(iter(lines.to_batches(length))) for r in b.to_pylist()]
        assert later == [e[:2] for e in expected] and later
        pairs = [tuple(r.values()) for b in line_dedup._close_to_first(num, den)(iter(drawn.to_batches(length))) for r in b.to_pylist()]
        assert pairs == expected


def test_a_line_does_not_repeat_itself_in_rows_of_one_id(spark):
    # two rows of one id: equal line numbers go together, so neither line stands before the other
    words = [f"w{k}" for k in range(60)]
    rows = [(5, " ".join(words)), (5, " ".join([*words[:-1], "other"])), (6, " ".join(words[1:]))]
    gone = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in gone} == {(6, 0)}


def test_contamination_by_brute_force(spark):
    rng = random.Random(9)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(n))) for k, n in enumerate([20, 15, 3, 1, 0, 13])] + [(7, None), (0, "W3 w4,w5")]
    docs = [" ".join(rng.choice(WORDS) for _ in range(50)) for _ in range(20)]
    docs += [f"{docs[0]} {items[0][1].upper()} {docs[1]}", items[1][1], None, ""]
    windows = {}
    for item, text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        n = min(len(w), decontaminate.WINDOW)
        for i in range(len(w) - n + 1):
            if n:
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    expected = {}
    for k, text in enumerate(docs):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        hit, found = set(), set()
        for g, owners in windows.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    found |= owners
        expected[k] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1000, 4):  # one broadcast set, and several
        rows = decontaminate.contamination(frame, bench, set_windows=limit).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows} == expected
        kept = {r.doc_id for r in decontaminate.without_documents(frame, bench, set_windows=limit).collect()}
        assert kept == {k for k, (n, h, *_) in expected.items() if not (h and 20 * h >= n)}
    spans = decontaminate.contamination(frame, bench)
    assert {r.doc_id: r.text for r in decontaminate.without_spans(frame, spans).collect()}[21] == ""


def test_verdicts_are_by_row_whatever_the_sets(spark):
    bench = spark.createDataFrame([(k, f"alpha{k} beta{k}") for k in range(9)], "item_id long, text string")
    rows = [(None, "alpha1 beta1", 0), (None, "clean", 1), (5, "alpha2 beta2", 2), (5, "also clean", 3), (6, None, 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row int")
    for limit in (1000, 4):
        left = decontaminate.without_documents(frame, bench, set_windows=limit)
        assert left.columns == frame.columns and sorted(r.row for r in left.collect()) == [1, 3, 4]


def test_no_item_outgrows_a_set(spark, monkeypatch):
    sets = []
    monkeypatch.setattr(decontaminate, "_rows", lambda w, rows=decontaminate._rows: sets.append(rows(w)) or sets[-1])
    bench = spark.createDataFrame([(None, f"left{k} right{k}") for k in range(200)] + [(k, "same text") for k in range(200)], "item_id long, text string")
    frame = spark.createDataFrame([(1, "left3 right3 left150 right150"), (2, "same text")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.contamination(frame, bench, set_windows=100).collect()}
    assert got == {1: (4, 1), 2: (2, 200)}
    assert len(sets) == 4 and sum(map(len, sets)) == 400 and max(map(len, sets)) < 150


def test_contamination_odd(odd_docs, no_docs, spark):
    bench = spark.createDataFrame([(1, "alpha BETA")], "item_id long, text string")
    rows = by_id(decontaminate.contamination(odd_docs, bench).collect())
    assert rows[1][0].n_hit == 2 and rows[4][0].n_words == 0 and not rows[4][0].contaminated
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd_docs, bench.limit(0)).collect())


def test_rules_odd(odd_docs, no_docs):
    rows = by_id(rules.quality_rules(odd_docs).collect())
    assert rows[4][0].n_words == 0 and rows[4][0].base_failed and not rows[4][0].kept
    assert (rows[7][0].n_words, rows[7][0].n_repeat_words) == (60_000, 60_000)
    assert rows[11][0].n_dup_lines == 0 and rows[10][0].word_chars == 300_000
    assert rules.quality_rules(no_docs).count() == 0


def test_licenses_odd(odd_docs, no_docs, spark):
    texts = ["x under THE mit\nLicense", "work is licensed under the GNU General Public License, version 3", "cc-by-nc cc by nc", None]
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_base, r.first_word, r.last_word, r.labels) for r in rows] == [
        (1, 1, 1, "mit"), (0, None, None, "gpl-3"), (2, 0, 3, "cc-by-nc"), (0, None, None, "")
    ]
    assert licenses.license_scan(odd_docs).count() == 14 and licenses.license_scan(no_docs).count() == 0


def test_wrapped_notices_are_found(spark):
    notices = [(label, text.split()) for label, text in licenses.TEMPLATES]
    texts = ["\n# ".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)) for _, w in notices]
    rng = random.Random(2)
    scattered = [w for _, n in notices for x in n for w in (x, *(rng.choice(WORDS) for _ in range(7)))]
    texts += [" ".join(scattered), " ".join(notices[1][1][:12]), texts[1] + "\nfiller " * 40 + texts[3]]
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r.doc_id: r for r in rows}
    for k, text in enumerate(texts):
        w = re.findall("[a-z0-9]+", text)
        expected, best = set(), 0.0
        for label, t in notices:
            n = max(len(set(w[i : i + licenses.SPREAD * len(t)]) & set(t)) for i in range(len(w)))
            if 100 * n >= licenses.CONTAINED * len(set(t)):
                expected.add(label)
                best = max(best, n / len(set(t)))
        expected |= set(filter(None, found[k].base_labels.split(",")))
        assert (found[k].labels, found[k].score) == (",".join(sorted(expected)), 1.0 if found[k].n_base else best)
    assert all(label in found[k].labels.split(",") for k, (label, _) in enumerate(notices))
    assert found[len(notices)].labels == found[len(notices) + 1].labels == "" and found[len(notices) + 2].labels == "bsd,mit"


def test_mix_odd(odd_docs, no_docs):
    rows = mixing.mixed(odd_docs).collect()
    assert len(rows) == 14 and all(0 <= r.taken <= 2 * r.size for r in rows)
    taken, target = {}, {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken) and None in taken
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6
    assert sorted((r.doc_id or 0, r.taken) for r in rows) == sorted((r.doc_id or 0, r.taken) for r in mixing.mixed(odd_docs).collect())
    assert mixing.mixed(no_docs).count() == 0


def test_maximal_passages_by_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 14)
        scores = [rng.choice([-0.3, -0.3, 0.5, 1.0]) for _ in range(n)]
        hits = [(k, s) for k, s in enumerate(scores) if s > 0]
        best = max([0.0] + [sum(scores[a:b]) for a in range(n) for b in range(a + 1, n + 1)])
        found = toxicity.maximal_passages(hits)
        assert all(abs(sum(scores[a:b]) - s) < 1e-9 for a, b, s in found)
        assert abs(max([s for *_, s in found], default=0.0) - best) < 1e-9
        assert all(b <= c for (_, b, _), (c, _, _) in zip(found, found[1:]))


def test_learned_scores_odd(odd_docs, odd_labels, no_docs, spark):
    for operator in (quality.quality, toxicity.toxicity):
        for labels in (odd_labels, odd_labels.limit(0)):
            rows = operator(odd_docs, labels).collect()
            assert len(rows) == 14 and all(0 <= r.score <= 1 for r in rows)
            assert operator(no_docs, labels).count() == 0
    left = toxicity.without_toxic(odd_docs, odd_labels)
    assert left.columns == odd_docs.columns and left.count() <= 14


def test_planted_slurs_are_found(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(400):
        words = [rng.choice(WORDS) for _ in range(60)]
        if k % 8 == 0:
            words[20:24] = [f"grubb{rng.choice('aeiou')}{rng.randrange(30)}" for _ in range(4)]
        docs.append((k, " ".join(words)))
        labels.append((k, int(k % 8 == 0)))
    rows = toxicity.toxicity(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    ).collect()
    assert {r.doc_id for r in rows if r.predicted} == {k for k, y in labels if y}
    assert all(any(p["first"] <= 20 and p["past"] >= 24 for p in r.passages) for r in rows if r.predicted)


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 1000)
    body = "ü\r\n\r\nWARC/1.1" * 900
    pages = [(3, "http://a/ b", body), (1, None, body), (2, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u\r\nEvil: 1", ""), (None, "u", body)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    from strandline.session import scratch_path

    chunks = warc.read_chunks(warc.write_archives(frame, scratch_path(spark, "warc-test"))).cache()
    whole = {}
    for r in sorted(chunks.collect(), key=lambda r: (str(r.page_id), r.chunk_no)):
        whole.setdefault(r.page_id, b"")
        whole[r.page_id] += bytes(r.chunk)
        assert r.record_type == "revisit" or r.digest_so_far == hashlib.sha256(whole[r.page_id]).hexdigest()
        assert len(r.chunk) <= 1000 and r.bytes_so_far == len(whole[r.page_id])
    rows = {r.page_id: r for r in warc.page_records(chunks).collect()}
    for page, _, html in pages:
        data = (html or "").encode()
        revisit = len(data) >= 100 and page != 1
        assert whole[page] == (b"" if revisit else data)
        assert (rows[page].payload_bytes, rows[page].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (rows[page].record_type, rows[page].refers_to) == (("revisit", 1) if revisit else ("response", None))
    assert warc.archive_round_trip(spark, frame.limit(0)).count() == 0


def test_quotes_are_linked_and_cut(spark):
    turns = [
        (1, 0, "user", "How does it work?\nPlease tell me."),
        (1, 1, "assistant", "It works like this.\nStep one is easy."),
        (1, 2, "user", "A wrote:\n> It works   LIKE this.\n> > How does it work?\nWhy?"),
        (1, 3, "assistant", "> Why?\nBecause."), (1, 4, "user", "> never said\nOk"), (1, 5, None, None), (None, 6, "user", "> Why?"),
        (2, 0, "user", "> Why?\nOther"),
    ]
    rows = {(r.conv_id, r.turn): r for r in quotations.reply_ordered(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).collect()}
    assert len(rows) == len(turns)
    assert (rows[1, 2].reply_to, rows[1, 2].body, rows[1, 2].n_quoted) == (1, "Why?", 2)
    assert rows[1, 3].path == [1, 2, 3] and rows[1, 3].body == "Because."
    assert rows[1, 4].reply_to is None and rows[1, 5].body == "" and rows[2, 0].reply_to is None
    assert quotations.reply_ordered(spark.createDataFrame(turns[:0], "conv_id long, turn int, role string, text string")).count() == 0


def test_deeper_quotes_are_linked(spark):
    turns = [
        (1, 0, "user", "How does it work?\nPlease tell me."), (1, 1, "assistant", "It works like this."),
        (1, 2, "user", "> A wrote:\n>> How does it work?\nWhy?"),
        (1, 3, "user", "B wrote:\n> from elsewhere\n>> It works like this.\n>>> Please tell me. And more of it.\nHm"),
        (1, 4, "user", "> Hm\n>> It works like this.\n>> Please tell me.\nOk"),
    ]
    frame = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    rows = {r.turn: r for r in quotations.reply_ordered(frame).collect()}
    assert [rows[k].reply_to for k in range(5)] == [None, None, 0, 1, 3]
    assert rows[2].path == [0, 2] and (rows[2].n_quoted, rows[2].n_linked, rows[2].body) == (2, 1, "Why?")
    assert rows[4].path == [1, 3, 4] and rows[3].body == "Hm"


def test_buckets_hold_their_numbers(spark):
    values = [*range(600), 1000, 4095, 4096, 10**6, 2**40 + 5]
    frame = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", rules.bucket(F.col("v")))
    low, high = rules._bucket_bounds(frame.b)
    assert all(r.low <= r.v <= r.high and r.high - r.low <= r.v / 256 for r in frame.withColumn("low", low).withColumn("high", high).collect())

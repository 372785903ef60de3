"""Line dedup: an exact set-similarity join over the distinct words of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import tokens
from strandline.llm.near_duplicates import MAP_BITS
from strandline.llm.tables import settled

#: Counters of the hashed word counts that define rarity; 4 MB as int32 on every executor.
#: Two words may share a counter: their order is then less sharp, but still one order.
COUNTERS = 1 << 20
#: Counters of one row: 10,000 rows, a batch on the way to Python, hold 10 MB.
SLICE = 1 << 8
#: Keys of two minima each that find most copies before the join; the join does not rely
#: on them.
KEYS = 3
#: Pairs of lines that a task looks at together.
PAIRS = 1 << 18
#: Prefix words of lines that a task passes on at once.
MEMBERS = 1 << 16

_MUL = tokens.mix(np.arange(77, 77 + 2 * KEYS, dtype=np.uint64)) | np.uint64(1)
_FOUND = "doc_id long, line_no int, print long, slice int, counts binary"
_PAIR = "doc_id long, line_no int, of_doc long, of_line int"
_MEMBER = "key long, doc_id long, parity long, parity2 long, spot long"
_LINE = "doc_id long, line_no int, size int, parity long, parity2 long, again boolean, whole long, keys array<long>, prefix array<int>"


def _line_blocks(values: pa.Array):
    """Per block of texts: words, line number over the block of each word, first line of each text."""
    for i, j, block in tokens.blocks(values, tokens.SPACE):
        breaks = np.flatnonzero(np.frombuffer(block.data, np.uint8) == 10)
        # a text starts a line of its own, whatever the byte before it
        line = np.searchsorted(breaks, block.start) + block.doc
        base = np.searchsorted(breaks, block.offset[:-1]) + np.arange(j - i)
        yield i, j, block, line, base


def _pieces(data: bytes, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per line of a block of texts: its text, its number in it, where it starts and ends."""
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    # a text starts a line of its own, whatever the byte before it
    start = np.sort(np.r_[offset[:-1], breaks + 1])
    end = np.sort(np.r_[breaks, offset[1:]])
    base = np.searchsorted(breaks, offset) + np.arange(len(offset))
    lines = np.diff(base)
    doc = np.repeat(np.arange(len(lines)), lines)
    number = np.arange(len(doc)) - np.repeat(base[:-1], lines)
    return doc, number, start, end


def _edges(line: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line by a fingerprint of its words in order; at the end the task's word counts."""
    total = np.zeros(COUNTERS, np.int64)
    waiting: list[np.ndarray] = []
    for batch in batches:
        for i, j, block, line, base in _line_blocks(batch.column(1)):
            waiting.append((block.hash >> np.uint64(44)).astype(np.int32))
            if sum(map(len, waiting)) >= COUNTERS:
                total += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
                waiting = []
            edge = _edges(line)
            size = np.diff(np.r_[edge, len(line)])
            if not len(edge):
                continue
            place = (np.arange(len(line)) - np.repeat(edge, size)).astype(np.uint64)
            print_ = tokens.mix(np.add.reduceat(tokens.mix(block.hash + place * np.uint64(0x9E3779B97F4A7C15)), edge))
            doc = block.doc[edge]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i).take(pa.array(doc)),
                    pa.array(line[edge] - base[doc], pa.int32()),
                    pa.array(print_.view(np.int64)),
                    pa.nulls(len(doc), pa.int32()),
                    pa.nulls(len(doc), pa.binary()),
                ],
                names=["doc_id", "line_no", "print", "slice", "counts"],
            )
    if waiting:
        total += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
    parts = np.minimum(total, 0x7FFFFFFF).astype(np.int32).reshape(-1, SLICE)
    some = np.flatnonzero(parts.any(axis=1))
    n = len(some)
    yield pa.RecordBatch.from_arrays(
        [
            pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()),
            pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary()),
        ],
        names=["doc_id", "line_no", "print", "slice", "counts"],
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of count slices; a slice is in one task only, which reads its parts one by one."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            got = np.frombuffer(part.as_buffer(), np.int32)
            sums[k] = sums[k] + got if k in sums else got.astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slice", "counts"]
    )


def word_counts(found: DataFrame) -> bytes:
    """Hashed counts of every word of every text, as int32 (larger counts stay at its top)."""
    sums = found.where("slice IS NOT NULL").select("slice", "counts").repartition("slice").mapInArrow(_added, "slice int, counts binary")
    out = np.zeros((COUNTERS // SLICE, SLICE), np.int32)
    for r in sums.toLocalIterator():
        out[r["slice"]] = np.minimum(np.frombuffer(r["counts"], np.int64), 0x7FFFFFFF)
    return out.tobytes()


def _slot(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return (np.mod(doc, 16777213) * 7919 + line) % MAP_BITS


def _bit_map(slots: DataFrame) -> bytes:
    """A bit map of fixed size of the column ``slot``, by partial bit_or."""
    rows = (
        slots.groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        .toArrow()
    )
    words = np.zeros(MAP_BITS // 64, np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words.tobytes()


def _marks_of(lines: DataFrame) -> bytes:
    """The bit map of hashed lines (``doc_id, line_no``)."""
    slot = F.pmod(F.pmod("doc_id", F.lit(16777213).cast("long")) * 7919 + F.col("line_no"), F.lit(MAP_BITS).cast("long"))
    return _bit_map(lines.select(slot.alias("slot")))


def _has(marks: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return ((marks[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _is_marked(marks: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return _has(marks, _slot(doc.astype(np.int64), line.astype(np.int64)))


def _distinct_words(block: tokens.Block, line: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (line, word) in the order of line, level (8 bits), hash: hashes, lines, texts."""
    h = block.hash
    if int(line[-1] if len(line) else 0) < 1 << 20:
        key = (line.astype(np.uint64) << np.uint64(44)) | (level.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28))
        order = np.argsort(key)
        key, h_ = key[order], h[order]
        clash = (key[1:] == key[:-1]) & (h_[1:] != h_[:-1])
    if int(line[-1] if len(line) else 0) >= 1 << 20 or clash.any():
        order = np.lexsort((h, level, line))
        h_ = h[order]
    line_ = line[order]
    new = np.ones(len(h_), bool)
    new[1:] = (h_[1:] != h_[:-1]) | (line_[1:] != line_[:-1])
    return h_[new], line_[new], block.doc[order][new]


def _prefix(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Words of a prefix: two sets of this similarity share one of them."""
    return size - (-(-size * num // den)) + 1


def _describe(counts, copies, num: int, den: int):
    """One row per line that has a word; ``again`` if it may be a copy.

    Sets so small that only an equal set of their own size is similar have a hash of the
    ``whole`` set; those that no set of another size is similar to either have no keys and
    no prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.frombuffer(counts.value, np.int32).astype(np.float32)
        marks = np.frombuffer(copies.value, np.uint64)
        # rarity in eighths of a doubling, so that it fits the sorting key
        level = np.minimum(np.floor(8 * np.log2(n + 1)), 255).astype(np.uint8)
        for batch in batches:
            for i, j, block, line, base in _line_blocks(batch.column(1)):
                if not len(line):
                    continue
                h, line_, doc = _distinct_words(block, line, level[(block.hash >> np.uint64(44)).astype(np.int64)])
                edge = _edges(line_)
                size = np.diff(np.r_[edge, len(h)])
                half = (h >> np.uint64(6)) & np.uint64(1)
                bit = np.uint64(1) << (h & np.uint64(63))
                parity, parity2 = (np.bitwise_xor.reduceat(np.where(half == k, bit, np.uint64(0)), edge) for k in (0, 1))
                joined = size * den >= (size + 1) * num
                low = [np.minimum.reduceat(h * m, edge)[joined] for m in _MUL]
                keys = np.stack([tokens.mix(low[2 * k] * np.uint64(KEYS) + low[2 * k + 1] + np.uint64(k)) for k in range(KEYS)], axis=1)
                word = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
                take = _prefix(size, num, den)
                small = take == 1
                whole = tokens.mix(np.add.reduceat(tokens.mix(h), edge))
                take[~joined] = 0
                rarest = word[np.arange(len(h)) < np.repeat(edge + take, size)]
                doc = doc[edge]
                ids = batch.column(0).slice(i, j - i).take(pa.array(doc))
                number = line_[edge] - base[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(number, pa.int32()),
                        pa.array(size, pa.int32()),
                        pa.array(parity.view(np.int64)),
                        pa.array(parity2.view(np.int64)),
                        pa.array(_is_marked(marks, ids.to_numpy(), number)),
                        pa.array(whole.view(np.int64), mask=~small),
                        tokens.lists_of(keys.reshape(-1).view(np.int64), np.where(joined, KEYS, 0)),
                        tokens.lists_of(rarest, take),
                    ],
                    names=["doc_id", "line_no", "size", "parity", "parity2", "again", "whole", "keys", "prefix"],
                )

    return run


def _heads(key: np.ndarray, held: tuple | None) -> np.ndarray:
    """Per row of sorted keys the first row of its key in this batch; -1 if that came in a batch before."""
    new = np.r_[held is None or key[0] != held[0], key[1:] != key[:-1]]
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))


def _of_head(column: np.ndarray, head: np.ndarray, held) -> np.ndarray:
    out = column[head]
    if head[0] < 0:
        out[head < 0] = held
    return out


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, line_no`` of the rows that stand later than the first row of their key.

    Rows come by key, doc_id and line_no; of a key only the first row is kept from batch to batch.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, line = (c.to_numpy() for c in batch.columns)
        head = _heads(key, held)
        firsts = [_of_head(c, head, held and held[k]) for k, c in ((1, doc), (2, line))]
        some = np.flatnonzero((doc != firsts[0]) | (line != firsts[1]))
        held = (key[-1], *(f[-1] for f in firsts))
        yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(line[some])], names=["doc_id", "line_no"])


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per line and key; ``spot`` is line number (high 32 bits) and size."""
    for batch in batches:
        doc, line, size, parity, parity2, keys = batch.columns
        row = np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy())
        spot = (line.to_numpy().astype(np.int64) << 32) | size.to_numpy()
        yield pa.RecordBatch.from_arrays(
            [keys.flatten(), *(pa.array(c[row]) for c in (doc.to_numpy(), spot, parity.to_numpy(), parity2.to_numpy()))],
            names=["key", "doc_id", "spot", "parity", "parity2"],
        )


def _close_to_first(num: int, den: int):
    """``(doc_id, line_no, of_doc, of_line)``: a line and the first line of its key, if they may be similar.

    Rows come by key, doc_id and spot; of a key only the first row is kept from batch to batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, *facts = (c.to_numpy() for c in batch.columns)
            head = _heads(key, held)
            firsts = [_of_head(c, head, held and held[k]) for k, c in enumerate(facts, 1)]
            held = (key[-1], *(f[-1] for f in firsts))
            doc, spot, parity, parity2 = facts
            of, at, *parities = firsts
            size, size2 = spot & 0xFFFFFFFF, at & 0xFFFFFFFF
            apart = sum(np.bitwise_count((p ^ q).view(np.uint64)).astype(np.int64) for p, q in zip((parity, parity2), parities))
            may = (np.minimum(size, size2) * den >= np.maximum(size, size2) * num) & (apart * (den + num) <= (size + size2) * (den - num))
            some = np.flatnonzero(may & ((doc != of) | (spot >> 32 != at >> 32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[some]), pa.array((spot[some] >> 32).astype(np.int32)), pa.array(of[some]), pa.array((at[some] >> 32).astype(np.int32))],
                names=["doc_id", "line_no", "of_doc", "of_line"],
            )

    return run


def _maybe(marks):
    """The rows whose line is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(marks.value, np.uint64)
        for batch in batches:
            yield batch.filter(pa.array(_is_marked(words, batch.column(0).to_numpy(), batch.column(1).to_numpy())))

    return run


def _members(marks):
    """One row per line and prefix word, of the lines that are not marked.

    ``key`` is the word (high 32 bits) and the size, ``spot`` the line number (high 32 bits),
    the word's place in the prefix and, in the lowest bit, whether the line is settled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(marks.value, np.uint64)
        for batch in batches:
            batch = batch.filter(pa.array(~_is_marked(words, batch.column(0).to_numpy(), batch.column(1).to_numpy())))
            prefix = batch.column(5)
            doc, line, size, parity, parity2 = (c.to_numpy() for c in batch.columns[:5])
            flat, n = prefix.flatten().to_numpy(), prefix.value_lengths().to_numpy()
            ends = np.cumsum(n, dtype=np.int64)
            spot = line.astype(np.int64) << 32
            a = 0
            while a < len(n):
                before = int(ends[a] - n[a])
                b = max(a + 1, int(np.searchsorted(ends, before + MEMBERS, "right")))
                row = np.repeat(np.arange(a, b), n[a:b])
                at = np.arange(before, before + len(row)) - np.repeat(ends[a:b] - n[a:b], n[a:b])
                word = flat[before : before + len(row)].astype(np.int64)
                a = b
                yield pa.RecordBatch.from_arrays(
                    [pa.array((word << 32) | size[row]), *(pa.array(c[row]) for c in (doc, parity, parity2)), pa.array(spot[row] | (at << 1))],
                    names=["key", "doc_id", "parity", "parity2", "spot"],
                )

    return run


def _sets_of_marked(wanted):
    """Word sets of the marked lines; texts without one are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(wanted.value, np.uint64)
        for batch in batches:
            for i, j, data, offset in tokens.text_blocks(batch.column(1)):
                doc, number, start, end = _pieces(data, offset)
                ids = batch.column(0).slice(i, j - i).take(pa.array(doc))
                some = np.flatnonzero(_is_marked(marks, ids.to_numpy(), number))
                if not len(some):
                    continue
                # only the marked lines are cut into words, each as a text of its own
                text = b"".join([data[a:b] for a, b in zip(start[some].tolist(), end[some].tolist())])
                block = tokens.cut_words(text, np.r_[0, np.cumsum(end[some] - start[some])], tokens.SPACE)
                h, line, _ = _distinct_words(block, block.doc, np.zeros(len(block.doc), np.uint8))
                words = tokens.lists_of(h.view(np.int64), np.bincount(line, minlength=len(some)))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(some)), pa.array(number[some], pa.int32()), words],
                    names=["doc_id", "line_no", "words"],
                )

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_members`` with line number, place and ``done`` in columns of their own."""
    for batch in batches:
        key, doc, parity, parity2, spot = batch.columns
        spot = spot.to_numpy()
        line, at = (spot >> 32).astype(np.int32), ((spot & 0xFFFFFFFF) >> 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [key, doc, pa.array(line), pa.array(at), parity, parity2, pa.array(spot & 1 == 1)],
            names=["key", "doc_id", "line_no", "at", "parity", "parity2", "done"],
        )


def _close_pairs(num: int, den: int):
    """``(doc_id, line_no, of_doc, of_line)``: an open line and an earlier one that share a prefix word and may be similar.

    Rows come by ``key``, a word (high 32 bits) and a size. A row meets those before it of the
    same word whose size is near enough, so only these are kept from batch to batch.
    """

    def overlap(total: np.ndarray) -> np.ndarray:
        return -(-total * num // (num + den))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(new[0]):
                continue
            before = 0 if held is None else len(held[0])
            rows = new if held is None else [np.concatenate(c) for c in zip(held, new)]
            key, _, _, at, _, _, done = rows
            size = key & 0xFFFFFFFF
            low = np.searchsorted(key, key - size + -(-size * num // den))
            # a smaller set of the pair with fewer words left than any overlap shares another word before
            short = size - at >= overlap(2 * size)
            for larger, smaller in ((~done, short), (done, short & ~done)):
                yield from _pairs_in(rows, size, before, low, larger, np.flatnonzero(smaller))
            held = [c[low[-1] :].copy() for c in rows]

    def _pairs_in(rows, size, before, low, larger, smaller) -> Iterator[pa.RecordBatch]:
        _, doc, line, at, parity, parity2, done = rows
        js = before + np.flatnonzero(larger[before:])
        first = np.searchsorted(smaller, low[js])
        n = np.searchsorted(smaller, js) - first
        some = n > 0
        js, first, n = js[some], first[some], n[some]
        ends = np.cumsum(n)
        a = 0
        while a < len(js):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            k = n[a:b]
            j = np.repeat(js[a:b], k)
            i = smaller[np.repeat(first[a:b] - np.cumsum(k) + k, k) + np.arange(len(j))]
            a = b
            total = size[i] + size[j]
            keep = np.minimum(size[i] - at[i], size[j] - at[j]) >= overlap(total)
            i, j, total = i[keep], j[keep], total[keep]
            apart = sum(np.bitwise_count((p[i] ^ p[j]).view(np.uint64)).astype(np.int64) for p in (parity, parity2))
            keep = apart * (den + num) <= total * (den - num)
            i, j = i[keep], j[keep]
            later = (doc[i] > doc[j]) | ((doc[i] == doc[j]) & (line[i] > line[j]))
            x, y = np.where(later, i, j), np.where(later, j, i)
            keep = ~done[x] & ((doc[x] != doc[y]) | (line[x] != line[y]))
            x, y = x[keep], y[keep]
            if len(x):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[x]), pa.array(line[x]), pa.array(doc[y]), pa.array(line[y])], names=["doc_id", "line_no", "of_doc", "of_line"]
                )

    return run


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.struct("doc_id", "line_no").alias("later"), F.struct(F.col("of_doc").alias("doc_id"), F.col("of_line").alias("line_no")).alias("earlier")
    )


def _similar(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """``(later, earlier)`` pairs of lines whose full word sets reach the similarity."""
    ends = pairs.select(F.explode(F.array("later", "earlier")).alias("x")).select("x.*").distinct()
    ends = settled(ends, "wanted-lines")
    wanted = rows.sparkSession.sparkContext.broadcast(_marks_of(ends))
    sets = (
        rows.mapInArrow(_sets_of_marked(wanted), "doc_id long, line_no int, words array<long>")
        .join(ends, ["doc_id", "line_no"], "left_semi")
        .select(F.struct("doc_id", "line_no").alias("place"), "words")
    )
    sets = settled(sets, "line-sets")
    common = F.size(F.array_intersect("a", "b"))
    return (
        pairs.join(sets.select(F.col("place").alias("later"), F.col("words").alias("a")), "later")
        .join(sets.select(F.col("place").alias("earlier"), F.col("words").alias("b")), "earlier")
        .where(common * (num + den) >= (F.size("a") + F.size("b")) * num)
        .select("later", "earlier")
    )


def repeated_lines(docs: DataFrame, share: float = 0.8) -> DataFrame:
    """Lines that repeat an earlier one: ``doc_id, line_no`` (from 0) of each.

    A line is a piece between line feeds; its set is its distinct words (A-Z lower-cased,
    parted by ASCII white space). A line that has a word, however short, repeats another if the Jaccard similarity of their sets is at least ``share`` (in whole
    hundredths). Earlier means a smaller doc_id, then a smaller line number; the earlier
    line counts even if it is itself a repeat, so the result depends on no order of work.

    1. Every word of every text is counted (hashed counters of fixed size): rarity. Lines of
       the same words in the same order meet by fingerprint; only the first goes on.
    2. A line becomes one row: size, parity map of its set (128 bits), its rarest words (prefix). A bit
       map of fixed size tells lines that are no copy for certain; the others are looked
       up in a join. Of equal sets of few words (1 to 4 at 0.8) only the first goes on; sets that can only equal another (1 to 3 at 0.8) are then settled.
    3. Lines that share a key of two minima are compared with the first of them,
       which settles most near copies with pairs that are linear in the lines. As in steps 1
       and 2, the rows of a key are sorted by place and read in a stream, the first one held.
    4. Lines not settled yet meet all lines with a shared prefix word: those of a word come in
       the order of their sizes, so that each meets only sets of a size near its own, under
       the positional filter and the parity map (which rules out pairs for certain). Pairs are
       confirmed on the full word sets.

    Null and empty texts, and lines of white space alone, have nothing to judge. Rows with a null id are left alone.
    Rows of a repeated id count as one document: their equal line numbers go together.
    Other columns are ignored.
    """
    num, den = round(share * 100), 100
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        "doc_id IS NOT NULL"
    )
    found = settled(rows.mapInArrow(_read, _FOUND), "lines")
    counts = spark.sparkContext.broadcast(word_counts(found))

    def later_of(lines: DataFrame) -> DataFrame:
        return lines.repartition("key").sortWithinPartitions("key", "doc_id", "line_no").mapInArrow(_later, "doc_id long, line_no int")

    copies = settled(later_of(found.where("slice IS NULL").select(F.col("print").alias("key"), "doc_id", "line_no")), "copies")
    marks = spark.sparkContext.broadcast(_marks_of(copies))
    every = settled(rows.mapInArrow(_describe(counts, marks, num, den), _LINE), "described-lines")
    gone = copies.select("doc_id", "line_no")
    # most lines need no look-up; what is left of the others is written, as several steps read it
    unsure = every.where("again").join(gone, ["doc_id", "line_no"], "left_anti")
    looked_up = settled(every.where("NOT again AND whole IS NOT NULL").union(unsure.select(every.columns)), "unsure-lines")

    # small sets: the first of each
    same = settled(later_of(looked_up.where("whole IS NOT NULL").select(F.col("whole").alias("key"), "doc_id", "line_no")), "equal-sets")
    looked_up = looked_up.where("size(prefix) > 0")
    kept = looked_up.where("whole IS NULL").union(
        looked_up.where("whole IS NOT NULL").join(same, ["doc_id", "line_no"], "left_anti").select(every.columns)
    )
    kept = settled(kept, "looked-up-lines")
    first = every.where("NOT again AND whole IS NULL AND size(prefix) > 0").union(kept)

    # step 3: the first line of each key
    quick = (
        first.select("doc_id", "line_no", "size", "parity", "parity2", "keys")
        .mapInArrow(_drawn, "key long, doc_id long, spot long, parity long, parity2 long")
        .repartition("key")
        .sortWithinPartitions("key", "doc_id", "spot")
        .mapInArrow(_close_to_first(num, den), _PAIR)
    )
    done = settled(_similar(settled(_ends(quick.distinct()), "quick-pairs"), rows, num, den).select("later.*").distinct(), "settled-lines")

    # step 4: all lines by their prefix words; each word meets itself in one pass over its lines by size
    marks = spark.sparkContext.broadcast(_marks_of(done))
    meet = _close_pairs(num, den)
    columns = ["doc_id", "line_no", "size", "parity", "parity2", "prefix"]
    every_line = first.select(columns)
    looked_up = every_line.mapInArrow(_maybe(marks), every_line.schema).join(done.withColumn("done", F.lit(True)), ["doc_id", "line_no"], "left")
    looked_up = looked_up.select(*columns[:-1], F.coalesce("done", F.lit(False)).alias("done"), F.posexplode("prefix").alias("at", "word")).select(
        F.expr("shiftleft(cast(word AS bigint), 32) | size").alias("key"), "doc_id", "parity", "parity2",
        F.expr("shiftleft(cast(line_no AS bigint), 32) | shiftleft(cast(at AS bigint), 1) | cast(done AS bigint)").alias("spot"),
    )
    close = (
        every_line.mapInArrow(_members(marks), _MEMBER)
        .union(looked_up)
        .repartition(F.shiftright("key", 32))
        .sortWithinPartitions("key")
        .mapInArrow(lambda batches: meet(_unpacked(batches)), _PAIR)
    )
    pairs = _ends(close.distinct())
    later = settled(_similar(settled(pairs, "line-pairs"), rows, num, den).select("later.*"), "later-lines")
    return gone.union(same).union(done).union(later).distinct()


def line_report(docs: DataFrame, share: float = 0.8) -> DataFrame:
    """Per document ``doc_id, n_lines, n_removed, removed`` (the sorted line numbers)."""
    gone = repeated_lines(docs, share).groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("removed"))
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    return (
        docs.select("doc_id", F.when(F.col("text").isNull(), F.lit(0)).otherwise(n_lines).cast("long").alias("n_lines"))
        .join(gone, "doc_id", "left")
        .select(
            "doc_id",
            "n_lines",
            F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
            F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        )
    )


def without_repeated_lines(docs: DataFrame, share: float = 0.8) -> DataFrame:
    """The documents with repeated lines cut out of ``text``; other columns as they were.

    Documents stay even if every line goes; their text is then empty.
    """
    gone = repeated_lines(docs, share).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    given = docs.columns
    names = [f"c{k}" for k in range(len(given))]  # whatever the columns of docs are called
    at, key = given.index("text"), names[given.index("doc_id")]
    joined = docs.toDF(*names).join(gone.withColumnRenamed("doc_id", "of"), F.col(key) == F.col("of"), "left").drop("of")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, removed = batch.columns
            texts = columns[at].to_pylist()
            for k in np.flatnonzero(removed.is_valid().to_numpy(zero_copy_only=False)).tolist():
                lines = set(removed[k].as_py())
                if texts[k] is not None:
                    texts[k] = "\n".join(line for n, line in enumerate(texts[k].split("\n")) if n not in lines)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=given)

    return joined.mapInArrow(cut, docs.schema)

"""Periodic run detection by block convolution with an exact integer transform.

A run is a stretch of consecutive words with smallest period q, at least ``exponent``
periods and ``least`` words long, that can't be extended. At scale B = 8, 16, 32, ...
periods B to 2B - 1 are looked for (1 to 15 at the first scale): such a run holds a whole
aligned block of B words together with its copy one period later. The squared difference
of a block and every shift of it within the window behind comes from one number-theoretic
transform of all blocks at once; zero means a possible copy. Zeros are taken modulo a
prime, so no copy is missed and a chance zero is ruled out when the match is extended
word by word. The distance of a copy seeds the extension to both sides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import tokens

#: Length of a run: at least LEAST words and EXPONENT periods.
LEAST, EXPONENT = 24, 3
#: First scale; with LEAST >= 3 * SCALE every run of a period up to SCALE holds a block and its copy.
SCALE = 8
#: 15 * 2**27 + 1: products of two residues fit 64 bits, transforms up to 2**27 points.
PRIME, ROOT, ROOT_BITS = 2013265921, 31, 27
#: Numbers of one batch of transforms, and words that are scanned together.
POINTS, WORDS = 1 << 18, 1 << 17

_P = np.uint64(PRIME)
_roots: dict[tuple[int, bool], list[np.ndarray]] = {}


def _stages(size: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the root of unity for each halving of ``size``."""
    if (size, inverse) not in _roots:
        out, h = [], size // 2
        while h:
            w = pow(ROOT, (PRIME - 1) // (2 * h), PRIME)
            w = pow(w, -1, PRIME) if inverse else w
            powers = np.ones(h, np.uint64)
            k = 1
            while k < h:
                powers[k : 2 * k] = powers[:k] * np.uint64(pow(w, k, PRIME)) % _P
                k *= 2
            out.append(powers)
            h //= 2
        _roots[size, inverse] = out
    return _roots[size, inverse]


def transform(a: np.ndarray) -> np.ndarray:
    """Transform of every row modulo the prime, in bit-reversed order."""
    rows, size = a.shape
    for w in _stages(size, False):
        v = a.reshape(rows, -1, 2, len(w))
        low, high = v[:, :, 0], v[:, :, 1]
        a = np.stack([(low + high) % _P, (low + (_P - high)) % _P * w % _P], 2).reshape(rows, size)
    return a


def back(a: np.ndarray) -> np.ndarray:
    """The inverse, from bit-reversed order."""
    rows, size = a.shape
    for w in reversed(_stages(size, True)):
        v = a.reshape(rows, -1, 2, len(w))
        low, high = v[:, :, 0], v[:, :, 1] * w % _P
        a = np.stack([(low + high) % _P, (low + (_P - high)) % _P], 2).reshape(rows, size)
    return a * np.uint64(pow(size, -1, PRIME)) % _P


def zero_shifts(x: np.ndarray, at: np.ndarray, block: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) for blocks ``at`` and distances low .. high - 1 whose squared difference is zero.

    ``x`` holds residues and reaches at least high + block past the last block.
    """
    width = high - low + block - 1
    size = 1 << (width - 1).bit_length()
    starts, shifts = [], []
    step = max(1, POINTS // size)
    for k in range(0, len(at), step):
        part = at[k : k + step]
        own = x[part[:, None] + np.arange(block)]
        behind = x[part[:, None] + np.arange(low, low + width)]
        a = np.zeros((len(part), size), np.uint64)
        b = np.zeros((len(part), size), np.uint64)
        a[:, :block] = own[:, ::-1]
        b[:, :width] = behind
        cross = back(transform(a) * transform(b) % _P)[:, block - 1 : width]
        square = np.zeros((len(part), width + 1), np.uint64)
        np.cumsum(behind * behind % _P, axis=1, out=square[:, 1:])
        sums = (own * own % _P).sum(1) % _P
        total = (sums[:, None] + (square[:, block:] - square[:, :-block])) % _P
        i, d = np.nonzero(total == 2 * cross % _P)
        starts.append(part[i])
        shifts.append(d + low)
    return (np.concatenate(starts), np.concatenate(shifts)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _reach(x: np.ndarray, i: int, d: int, limit: int, step: int) -> int:
    """How many words from i on, going by ``step``, equal the ones d later."""
    n, chunk = 0, 64
    while n < limit:
        c = min(chunk, limit - n)
        if step > 0:
            off = x[i + n : i + n + c] != x[i + n + d : i + n + d + c]
        else:
            off = x[i - n - c + 1 : i - n + 1][::-1] != x[i - n - c + 1 + d : i - n + 1 + d][::-1]
        if off.any():
            return n + int(off.argmax())
        n, chunk = n + c, chunk * 2
    return n


def _primitive(x: np.ndarray, start: int, d: int) -> bool:
    """The d words from ``start`` on are no repetition of fewer words."""
    k, rest = 2, d
    while rest > 1:
        if k * k > rest:
            k = rest
        if rest % k == 0:
            q = d // k
            if np.array_equal(x[start : start + d - q], x[start + q : start + d]):
                return False
            while rest % k == 0:
                rest //= k
        k += 1
    return True


def find_runs(ids: np.ndarray, least: int = LEAST, exponent: int = EXPONENT, longest: int | None = None) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers, by start, then period.

    ``longest``: an upper bound of the length of a run, where one is known. The scales are
    complete for exponents of at least 3 and least lengths of at least 3 * SCALE.
    """
    if exponent < 3 or least < 3 * SCALE:
        raise ValueError("runs have at least 3 periods and 24 words")
    n = len(ids)
    longest = n if longest is None else min(n, longest)
    runs: list[tuple[int, int, int]] = []
    if longest < least:
        return runs
    # distance to the next word of the same number: a block with a copy has it in reach for every word
    order = np.argsort(ids, kind="stable")
    ahead = np.full(n, n, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    x = None
    scale = SCALE
    far = ahead[: n - n % scale].reshape(-1, scale).max(1)
    while True:
        low, high = (1 if scale == SCALE else scale), 2 * scale
        if low * exponent > longest:
            break
        # the known run that a block starts in: a window inside it shows multiples of its period only
        cover = np.full(len(far), -1)
        for r, (s, length, _) in enumerate(runs):
            cover[-(-s // scale) : (s + length) // scale + 1] = r
        of = np.array([(s + length, q) for s, length, q in runs] + [(0, n + 1)], np.int64)
        at = np.flatnonzero(far < high).astype(np.int64)
        end, period = of[cover[at]].T
        at = at[(period > scale) | ((at + 3) * scale > end)] * scale
        if len(at):
            if x is None:
                x = np.zeros(n, np.uint64)
                x[:] = ids
                x = x % _P
            # words past the end get a number that no word has
            tail = np.full(max(0, int(at[-1]) + high + scale - n), PRIME - 1, np.uint64)
            starts, shifts = zero_shifts(np.concatenate([x, tail]) if len(tail) else x, at, scale, low, high)
            inside = starts + shifts + scale <= n
            starts, shifts = starts[inside], shifts[inside]
            end, period = of[cover[starts // scale]].T
            new = (shifts % period != 0) | (starts + shifts + scale > end)
            starts, shifts = starts[new], shifts[new]
            order = np.lexsort((starts, shifts))
            last, end = 0, 0
            for start, d in zip(starts[order].tolist(), shifts[order].tolist()):
                if d == last and start + scale + d <= end:
                    continue
                right = _reach(ids, start, d, n - d - start, 1)
                if right < scale:
                    continue
                left = _reach(ids, start - 1, d, start, -1)
                last, end = d, start + right + d
                length = left + right + d
                if length >= least and length >= exponent * d and _primitive(ids, start - left, d):
                    runs.append((start - left, length, d))
        if len(far) < 2:
            break
        scale *= 2
        far = far[: len(far) - len(far) % 2].reshape(-1, 2).max(1)
    return sorted(set(runs), key=lambda r: (r[0], r[2], r[1]))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One text in ten, chosen by the checksum of its id, repeats a stretch of its words to the end."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * (-(-(n - a) // p)))[: n - a]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_COLUMNS = {
    "doc_id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(),
    "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string(),
    "runs": pa.list_(_RUN), "collapsed": pa.string(),
}
_DDL = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed string"
)


def _greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Greatest length / period without rounding; ties to the smallest start, then period."""
    best = runs[0]
    for r in runs[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _rows(texts: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
    numbers: list[np.ndarray] = []
    base = 0
    for _, words in texts:
        seen: dict[bytes, int] = {}
        numbers.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + base)
        base += len(seen)
    first = np.cumsum([0] + [len(a) for a in numbers])
    # texts share no word number, so no run crosses from one to the next
    found = find_runs(np.concatenate(numbers), longest=max(len(a) for a in numbers))
    owner = np.searchsorted(first, [r[0] for r in found], "right") - 1
    per: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, (start, length, period) in zip(owner.tolist(), found):
        per[i].append((start - int(first[i]), length, period))
    out = []
    for (doc_id, words), runs in zip(texts, per):
        if runs:
            keep = np.ones(len(words), bool)
            for start, length, period in runs:
                keep[start + period : start + length] = False
            words = [words[i] for i in np.flatnonzero(keep).tolist()]
            best = _greatest(runs)
            shown = (*best, 1000 * best[1] // best[2])
        else:
            shown = (None,) * 4
        collapsed = b" ".join(words)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
        digests = (hashlib.sha256(listed).hexdigest(), hashlib.sha256(collapsed).hexdigest())
        named = [{"start": s, "length": n, "period": q} for s, n, q in runs]
        out.append((doc_id, len(runs), *shown, *digests, named, collapsed.decode()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _COLUMNS.values())], list(_COLUMNS))


def _scan(plant: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[tuple[int | None, list[bytes]]] = []
        n = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, data, offset in tokens.text_blocks(batch.column(1), lower=False):
                for k in range(i, j):
                    # bytes.split() cuts at ASCII white space: space and \x09 to \x0D
                    words = data[int(offset[k - i]) : int(offset[k - i + 1])].split()
                    texts.append((ids[k], planted(words, ids[k]) if plant else words))
                    n += len(words)
                    if n >= WORDS or len(texts) >= WORDS:
                        yield _rows(texts)
                        texts, n = [], 0
        if texts:
            yield _rows(texts)

    return scan


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Runs of every whole text and the text with each run cut to its first period.

    One row per row of ``docs`` (``doc_id``, ``text``; other columns are ignored, whatever
    their names): ``n_runs``, the run of the greatest length / period (``start``,
    ``length``, ``period``, ``exponent_milli``; null without a run), ``runs`` by start,
    then period, ``collapsed``, and the digests of both. Words are runs of other than
    ASCII white space. A null or empty text has no words: no runs, an empty collapsed
    text. Equal rows give equal rows; an empty table gives none. ``plant`` first repeats
    a stretch of words in one text in ten (chosen by the checksum of ``doc_id``, never
    where that is null). No row leaves its task: texts are independent, and one text is
    worked on as a whole in memory.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(_scan(plant), _DDL)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every periodic run of a text cut to its first period; texts without a run stay as they are.

    Null texts stay null. Columns and their order are those of ``docs``; the key of the
    rewriting is the text itself, so rows need no unique id.
    """
    schema = docs.schema
    at = schema.names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            words = [t.encode().split() if t is not None else [] for t in texts]
            i = 0
            out: list[str | None] = []
            while i < len(words):
                j, n = i, 0
                while j < len(words) and (j == i or n + len(words[j]) <= WORDS):
                    n += len(words[j])
                    j += 1
                part = _rows([(None, w) for w in words[i:j]])
                runs, collapsed = part.column(1).to_pylist(), part.column(9).to_pylist()
                out += [c if r else t for t, r, c in zip(texts[i:j], runs, collapsed)]
                i = j
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(cut, schema)

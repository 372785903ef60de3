"""MinHash near-dedup: universal minima, banding, verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import tokens
from strandline.llm.components import connected_components
from strandline.llm.tables import settled

#: 48 bands of 6 minima. At a Jaccard similarity of 0.8 a pair meets in no band with a
#: probability of (1 - 0.8**6)**48 = 5e-7; at 0.3 it meets in one with 3 %.
BANDS, ROWS = 48, 6
MINIMA = BANDS * ROWS
#: Bits of the map that lets texts without candidates skip the verification pass.
MAP_BITS = 1 << 24
#: Bits of the parity map of a set: bit b is the parity of its shingles that fall on b.
PARITY_BITS = 1024

_ODD = tokens.mix(np.arange(1, MINIMA + 1, dtype=np.uint64) << np.uint64(20))
_MULTIPLY = (_ODD >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = tokens.mix(_ODD).astype(np.uint32)


def _minima(grams: np.ndarray) -> np.ndarray:
    """The smallest value of each hash of the universal family a * x + b over the set."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    best = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        part = x[None, k : k + 1024] * _MULTIPLY[:, None]
        part += _ADD[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def _band_keys(best: np.ndarray) -> np.ndarray:
    rows = best.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = tokens.mix(key + rows[:, k])
    return key


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, signs, bits, bands = [], [], [], [], []
            for _, _, block in tokens.blocks(batch.column(1), tokens.SPACE):
                for grams in tokens.shingle_sets(block, width):
                    sizes.append(len(grams))
                    if not len(grams):
                        prints.append(None), signs.append(None), bits.append(None), bands.append(np.zeros(0, np.uint64))
                        continue
                    best = _minima(grams)
                    low = best.view(np.uint8)[::4]
                    prints.append(blake2b(grams.tobytes(), digest_size=16).digest())
                    signs.append(low.tobytes())
                    parity = np.bincount(grams & np.uint64(PARITY_BITS - 1), minlength=PARITY_BITS) & 1
                    bits.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
                    bands.append(_band_keys(best))
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.array(signs, pa.binary()),
                    tokens.list_column([none if b is None else b for b in bits], pa.int64()),
                    tokens.list_column(bands, pa.int64()),
                ],
                names=["doc_id", "n_shingles", "print", "sign", "parity", "bands"],
            )

    return run


def _sets_of_marked(width: int, marks):
    """Shingle sets of the rows whose slot is marked; the others are skipped unread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(marks.value, np.uint64)
        for batch in batches:
            slot = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = (words[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)
            batch = batch.filter(pa.array(hit.astype(bool)))
            parts = []
            for _, _, block in tokens.blocks(batch.column(1), tokens.SPACE):
                parts.extend(tokens.shingle_sets(block, width))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), tokens.list_column(parts, pa.int64())], names=["doc_id", "grams"]
            )

    return run


def _marked(ids: DataFrame, bits: int) -> bytes:
    """A bit map of fixed size of hashed ids, built by partial bit_or on the executors."""
    slot = F.expr(f"pmod(xxhash64(doc_id), {bits}L)")
    rows = (
        ids.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        .collect()
    )
    words = np.zeros(bits // 64, np.int64)
    for r in rows:
        words[r["word"]] = r["bits"]
    return words.tobytes()


def _agreeing(pairs: DataFrame, signed: DataFrame, share: float) -> DataFrame:
    """Pairs whose signatures allow the similarity: within five standard deviations of it.

    One byte of each minimum is kept; bytes of different minima agree once in 256.
    """
    allowed = MINIMA * (share - 5 * (share * (1 - share) / MINIMA) ** 0.5)
    side = lambda p: signed.select(F.col("doc_id").alias(p), F.col("sign").alias(f"sign_{p}"), F.col("n_shingles").alias(f"n_{p}"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, MINIMA)
            b = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, MINIMA)
            yield batch.select([0, 1]).filter(pa.array((a == b).sum(axis=1) >= allowed))

    num, den = _ratio(share)
    return (
        pairs.join(side("u"), "u")
        .join(side("v"), "v")
        .where(F.least("n_u", "n_v") * den >= F.greatest("n_u", "n_v") * num)
        .select("u", "v", "sign_u", "sign_v")
        .mapInArrow(kept, "u long, v long")
    )


def _ratio(share: float) -> tuple[int, int]:
    return round(share * 100), 100


def _verified(pairs: DataFrame, docs: DataFrame, width: int, share: float) -> DataFrame:
    """Links among the pairs: Jaccard similarity of the full shingle sets of whole texts."""
    spark = docs.sparkSession
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    marks = spark.sparkContext.broadcast(_marked(ids, MAP_BITS))
    slot = F.expr(f"pmod(xxhash64(doc_id), {MAP_BITS}L)").alias("slot")
    sets = settled(
        docs.select("doc_id", "text", slot)
        .mapInArrow(_sets_of_marked(width, marks), "doc_id long, grams array<long>")
        .join(ids, "doc_id", "left_semi"),
        "shingle-sets",
    )
    num, den = _ratio(share)
    common = F.size(F.array_intersect("grams_u", "grams_v")).cast("long")
    return (
        pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("grams").alias("grams_u")), "u")
        .join(sets.select(F.col("doc_id").alias("v"), F.col("grams").alias("grams_v")), "v")
        .select("u", "v", common.alias("common"), (F.size("grams_u") + F.size("grams_v")).cast("long").alias("total"))
        .where(F.col("common") * den >= (F.col("total") - F.col("common")) * num)
        .select("u", "v")
    )


def near_duplicates(docs: DataFrame, width: int = 5, share: float = 0.8) -> DataFrame:
    """Near-duplicate groups of whole texts: ``doc_id, n_shingles, component_id, kept``.

    A text is the set of its distinct ``width``-word shingles (A-Z lower-cased, words
    parted by ASCII white space); fewer words make one shingle, no word an empty set,
    linked with nothing. Texts are linked when the Jaccard similarity of their sets is
    at least ``share`` (in whole hundredths); groups are what links reach, named by their smallest id;
    ``kept`` marks that id.

    1. Signatures of ``MINIMA`` universal hash minima; equal sets meet by fingerprint, and
       their smallest id stands for them.
    2. Per band bucket two leaders (smallest id, smallest hashed id) take a pair with
       each member: linear in the members, whatever the size of the bucket.
    3. Pairs that the signatures allow are confirmed on the full sets; links become
       components.
    4. In buckets that still hold several components, the pairs between components that
       length and parity map allow are confirmed too, so no pair that meets in a bucket
       and could join two groups goes unverified.

    Null and empty texts form groups of their own. Rows with a null id are kept out of
    every group: ``component_id`` null, ``kept`` true. A repeated id counts as one
    document with the union of its rows' links; each of its rows is returned. Other
    columns are ignored. An empty table gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = settled(
        rows.mapInArrow(
            _sign(width),
            "doc_id long, n_shingles long, print binary, sign binary, parity array<long>, bands array<long>",
        ),
        "signatures",
    )
    known = table.where("doc_id IS NOT NULL AND n_shingles > 0")
    same = known.groupBy("print").agg(F.min("doc_id").alias("v"))
    equal = known.select("doc_id", "print").join(same, "print").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v")
    leaders = same.select(F.col("v").alias("doc_id")).distinct()
    signed = settled(known.join(leaders, "doc_id", "left_semi").dropDuplicates(["doc_id", "print"]), "signed")

    buckets = signed.select("doc_id", F.explode("bands").alias("band"))
    order = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")
    heads = (
        buckets.groupBy("band")
        .agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last"), F.min(order)["doc_id"].alias("b"))
        .where("a < last")
        .drop("last")
    )
    shared = settled(buckets.join(heads, "band"), "buckets")
    pair = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    first = (
        shared.select("doc_id", F.explode(F.array("a", "b")).alias("head"))
        .where("doc_id <> head")
        .select(*pair("doc_id", "head"))
        .distinct()
    )
    tried = settled(_agreeing(first, signed, share), "candidates")
    links = settled(_verified(tried, rows, width, share), "confirmed")
    more = _open_pairs(shared, signed, connected_components(links), share)
    more = settled(_agreeing(more, signed, share).join(tried, ["u", "v"], "left_anti"), "candidates")
    if not more.isEmpty():
        links = links.union(_verified(more, rows, width, share))
    every = connected_components(links.union(equal))
    return (
        table.select("doc_id", "n_shingles")
        .join(every.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )


def _open_pairs(shared: DataFrame, signed: DataFrame, groups: DataFrame, share: float) -> DataFrame:
    """Pairs of a bucket whose components differ and whose sets may be similar enough.

    A shingle that only one of two sets has turns one bit of the parity map, so sets
    whose maps differ in more bits than the similarity allows are ruled out for certain.
    """
    members = (
        shared.select("band", "doc_id")
        .join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select("band", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    )
    several = members.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    facts = signed.select("doc_id", "n_shingles", "parity")
    still = settled(members.join(several.select("band"), "band", "left_semi").join(facts, "doc_id"), "open")
    num, den = _ratio(share)
    x, y = still.alias("x"), still.alias("y")
    small, large = F.least("x.n_shingles", "y.n_shingles"), F.greatest("x.n_shingles", "y.n_shingles")
    apart = sum(
        (F.bit_count(F.col("x.parity")[k].bitwiseXOR(F.col("y.parity")[k])) for k in range(PARITY_BITS // 64)), F.lit(0)
    )
    return (
        x.join(
            y,
            (F.col("x.band") == F.col("y.band"))
            & (F.col("x.doc_id") > F.col("y.doc_id"))
            & (F.col("x.label") != F.col("y.label"))
            & (small * den >= large * num)
            & (apart * (den + num) <= (small + large) * (den - num)),
        )
        .select(F.col("x.doc_id").alias("u"), F.col("y.doc_id").alias("v"))
        .distinct()
    )


def without_near_duplicates(docs: DataFrame, width: int = 5, share: float = 0.8) -> DataFrame:
    """The documents less all but the smallest id of each near-duplicate group, columns as they were.

    Rows with a null id stay. Rows that repeat an id stay or go together.
    """
    gone = near_duplicates(docs, width, share).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)

"""Mixing sources to target weights: weighted sampling without replacement by exponential keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.tables import n_plain_words, settled

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words, and the most of one source.
MIX_SHARE, MOST_EPOCHS = 1.5, 2
#: Key bins per unit of ln(key): a bin holds at most 0.4 / KEY_BINS of a source's documents
#: of one quality, so only this share is ever sorted.
KEY_BINS = 256


def lexical_quality(text: Column, size: Column) -> Column:
    """A weight in (0, 1] from the text alone: few markup symbols, and not too short.

    Ten per cent of symbols (``#*$%&|<>!``) or more give the lowest weight, 0.05, and so
    do texts of no word; texts of 50 words or more lose nothing for their length.
    """
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>!", ""))
    tidy = 1 - 10 * symbols / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.05), tidy * F.least(F.lit(1.0), size / F.lit(50))), F.lit(0.05))


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target``: shares by weight, none above ``MOST_EPOCHS`` times its size.

    Sources in the order of the size at which each fills up: the first ones are full, and
    what they cannot take raises the common level of the others. One row per source.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    ordered = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ordered = ordered.withColumn("weight", weight).withColumn("cap", MOST_EPOCHS * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    total = F.sum("source_size").over(all_)
    level = (total * MIX_SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = ordered.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))
    return levels.withColumn("first", F.min(fits).over(all_)).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("first.level") * F.col("weight")).alias("target")
    )


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """What the mix takes of each document: ``doc_id, source, size, source_size, target, epochs, taken``.

    ``size`` counts words (null text: none). Every source gets ``target`` words: whole epochs
    of all its documents first, then a fraction chosen by Efraimidis and Spirakis: each
    document draws the key -ln(u) / quality, documents are taken in the order of the key
    until the target is reached, and the document that crosses it gives only the words
    still missing. u comes from a hash of seed and id, so reruns agree, and from nothing
    else. Ties go by id, then size; rows that agree in all of these share a
    place in the order, whichever comes first.

    Keys fall into bins of ln(key); sizes are summed by source and bin, so bins before the
    target are taken whole, bins behind it not at all, and only the bin that crosses it is
    sorted: no source is ever sorted whole in one task. A null source is one of its own, last in
    order; a null id draws as the empty string. Sources without words get nothing.
    """
    size = n_plain_words(F.col("text").cast("string"))
    text = F.col("text").cast("string")
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") + 0.5) / 2.0**52
    facts = (
        docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), text.alias("t"), u.alias("u"))
        .select("doc_id", "source", "size", (-F.log("u") / lexical_quality(F.col("t"), F.col("size"))).alias("key"))
        .withColumn("bin", F.floor(F.log("key") * KEY_BINS))
    )
    facts = settled(facts, "mix-keys")
    bins = settled(facts.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "mix-bins")
    targets = source_targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    own = F.col("p.source").eqNullSafe(F.col("b.source"))
    upto = F.sum("bin_size").over(Window.partitionBy("b.source").orderBy("bin"))
    crossing = (
        bins.alias("b")
        .join(plan.alias("p"), own)
        .select("b.source", "bin", "bin_size", "rest", upto.alias("upto"))
        .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("bin_size") < F.col("rest")))
        .select("source", F.col("bin").alias("cut"), (F.col("upto") - F.col("bin_size")).alias("before"))
    )
    plan = settled(
        plan.alias("p").join(crossing.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
        .select("p.*", "cut", "before"),
        "mix-plan",
    )
    joined = facts.alias("f").join(plan.alias("p"), F.col("f.source").eqNullSafe(F.col("p.source")))
    joined = joined.select("f.*", "p.source_size", "p.target", "p.epochs", "p.rest", "p.cut", "p.before")
    columns = ["doc_id", "source", "size", "source_size", "target", "epochs"]
    whole = joined.where("cut IS NULL OR bin <> cut").select(
        *columns, (F.col("epochs") * F.col("size") + F.when(F.col("bin") < F.col("cut"), F.col("size")).otherwise(0)).alias("taken")
    )
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    missing = F.col("rest") - F.col("before") - (F.sum("size").over(order) - F.col("size"))
    edge = joined.where("bin = cut").select(
        *columns, (F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), missing))).alias("taken")
    )
    return whole.union(edge)

"""Chat formatting: quotation linking and reply-ordered conversations. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.tables import ascii_lower, settled

_MARKS = r"^(?:[ \t]*>)+"
_ATTRIBUTION = r"wrote:[ \t]*$"
#: Words of a run that a quoted passage and its original share.
SHINGLE = 4


def _level(line: Column) -> Column:
    """Depth of a quoted line: the ``>`` marks it begins with."""
    return F.length(F.translate(F.regexp_extract(line, _MARKS, 0), " \t", ""))


def _words(line: Column) -> Column:
    """Words of a line without its quote marks, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(F.regexp_replace(line, _MARKS, "")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _keys(words: Column) -> Column:
    """64-bit hashes of all runs of ``SHINGLE`` words, each once; of the whole where there are fewer, none without a word."""
    # (a slice would copy the whole array for each run)
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    none = F.array().cast("array<bigint>")
    return F.array_distinct(F.when(F.size(words) >= SHINGLE, runs).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(none))


def parsed(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, lines`` with lines as (level, body, words) and attributions marked.

    A line that ends in "wrote:" and comes right before a line of a deeper level is an
    attribution, itself quoted or not.
    """
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\r?\n", -1)
    cut = turns.select(
        F.col("conv_id"), F.col("turn"), F.col("role").cast("string").alias("role"),
        F.transform(lines, lambda x: F.struct(_level(x).alias("level"), x.alias("body"), _words(x).alias("words"))).alias("cut"),
    )
    return cut.select(
        "conv_id", "turn", "role",
        F.transform(
            "cut",
            lambda x, i: F.struct(
                x["level"].alias("level"),
                x["body"].alias("body"),
                x["words"].alias("words"),
                (x["body"].rlike(_ATTRIBUTION) & (F.coalesce(F.get("cut", i + 1)["level"], F.lit(0)) > x["level"])).alias("attribution"),
            ),
        ).alias("lines"),
    )


def _passage(level: Column) -> Column:
    """The words of a message at one quote level, attributions left out."""
    lines = F.filter("lines", lambda x: (x["level"] == level) & ~x["attribution"])
    return F.flatten(F.transform(lines, lambda x: x["words"]))


def quote_links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to, n_linked``: the message that a turn's quotes come from.

    A quoted passage is all that a message quotes at one level, however its lines are
    broken: it goes by the hashes of its runs of ``SHINGLE`` words (of the whole, where it is
    shorter). The original of a run is the first turn of the conversation that has it in its
    own text (a short passage: as a line of its own), found by a partial minimum per
    (conversation, hash): one row for each key, so the join makes no pairs within a group.
    A turn replies to the earlier turn from which most runs come, at the lowest of its
    quote levels at which that is at least a quarter of them; ties go to the later one.
    """
    known = messages.where("turn IS NOT NULL AND conv_id IS NOT NULL")
    levels = F.array_distinct(F.transform("lines", lambda x: x["level"]))
    short = F.transform(
        F.filter("lines", lambda x: (x["level"] == 0) & ~x["attribution"] & F.size(x["words"]).between(1, SHINGLE - 1)),
        lambda x: F.xxhash64(x["words"]),
    )
    # written, as the optimizer would else put the words together again for each run of them
    said = settled(
        known.select("conv_id", "turn", "lines", F.explode(levels).alias("level")).select(
            "conv_id", "turn", "level", _passage(F.col("level")).alias("words"), F.when(F.col("level") == 0, short).alias("short")
        ),
        "passages",
    )
    passages = said.where("level > 0 AND size(words) > 0").select("conv_id", "turn", "level", _keys(F.col("words")).alias("keys"))
    quoted = passages.select("conv_id", "turn", "level", F.size("keys").alias("n"), F.explode("keys").alias("key"))
    own = (
        said.where("level = 0")
        .join(passages.select("conv_id").distinct(), "conv_id", "left_semi")
        .select("conv_id", "turn", F.explode(F.array_union(_keys(F.col("words")), F.col("short"))).alias("key"))
        .join(quoted.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi")
        .groupBy("conv_id", "key")
        .agg(F.min("turn").alias("original"))
    )
    votes = (
        quoted.join(own, ["conv_id", "key"])
        .where("original < turn")
        .groupBy("conv_id", "turn", "level", "n", "original")
        .agg(F.count_distinct("key").alias("n_linked"))
        .where("4 * n_linked >= n")
    )
    best = F.max(F.struct(-F.col("level"), "n_linked", "original")).alias("best")
    return votes.groupBy("conv_id", "turn").agg(best).select(
        "conv_id", "turn", F.col("best.original").alias("reply_to"), F.col("best.n_linked").alias("n_linked")
    )


def reply_paths(links: DataFrame) -> DataFrame:
    """``conv_id, turn, path``: turns from the first message of a chain of replies down to each reply.

    Chains are joined end to end, doubling in length every round.
    """
    state = settled(links.select("conv_id", "turn", F.col("reply_to").alias("up"), F.array("reply_to", "turn").alias("path")), "reply-paths")
    while True:
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        longer = state.join(above, ["conv_id", "up"], "left")
        if longer.where("next IS NOT NULL").isEmpty():
            return state.select("conv_id", "turn", "path")
        joined = F.when(F.col("head").isNull(), F.col("path")).otherwise(
            F.concat(F.slice("head", F.lit(1), F.size("head") - 1), "path")
        )
        state = settled(longer.select("conv_id", "turn", F.coalesce("next", "up").alias("up"), joined.alias("path")), "reply-paths")


def reply_ordered(turns: DataFrame) -> DataFrame:
    """Messages without quotes: ``conv_id, turn, role, reply_to, path, n_quoted, n_linked, body, formatted``.

    Ordering a conversation by ``path`` puts each reply after the message it quotes; turns
    that quote nothing known stand at their own turn. Rows come range-partitioned
    and sorted by conversation, path, turn, so even one huge conversation spreads over tasks.
    ``body`` is the text less quoted lines and attributions, ends trimmed of white space;
    ``formatted`` is the body in role marks.

    Null text is an empty body; a null role prints as "unknown"; null conversations and
    turns are never linked; repeated rows of a turn share its link. Other columns are ignored.
    """
    messages = settled(parsed(turns), "parsed-turns")
    links = settled(quote_links(messages), "quote-links")
    paths = reply_paths(links)
    own = F.filter("lines", lambda x: (x["level"] == 0) & ~x["attribution"])
    body = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    rows = messages.select(
        "conv_id", "turn", "role", body.alias("body"), F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted")
    )
    known = links.join(paths, ["conv_id", "turn"])
    return (
        rows.join(known, ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            "role",
            "reply_to",
            F.coalesce("path", F.array("turn")).alias("path"),
            "n_quoted",
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            "body",
            F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "body", F.lit("\n")).alias("formatted"),
        )
        .repartitionByRange("conv_id", "path", "turn")
        .sortWithinPartitions("conv_id", "path", "turn")
    )

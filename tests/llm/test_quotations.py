"""Quotes wrapped anew, quotes of many kinds in one table, odd inputs."""

from pyspark.sql import functions as F

from strandline.llm import quotations
from strandline.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn int, role string, text string"
TEXT = "the quick brown fox jumps over the lazy dog and then it sleeps for the rest of a long day"


def linked(spark, turns):
    return {(r.conv_id, r.turn): r for r in quotations.reply_ordered(spark.createDataFrame(turns, SCHEMA)).collect()}


def test_a_quote_wrapped_anew_is_linked(spark):
    words = TEXT.split()
    wrap = lambda width, marks: "\n".join(marks + " ".join(words[k : k + width]) for k in range(0, len(words), width))
    turns = [(1, 0, "a", wrap(7, "")), (1, 1, "b", "unrelated words only here"), (1, 2, "a", wrap(4, "> ") + "\nyes"), (1, 3, "b", wrap(5, "> > ") + "\n> yes\nno")]
    rows = linked(spark, turns)
    assert rows[1, 2].reply_to == 0 and rows[1, 2].n_linked == len(words) - 3 and rows[1, 2].body == "yes"
    assert rows[1, 3].reply_to == 2 and rows[1, 3].path == [0, 2, 3]


def test_few_common_words_are_no_quote(spark):
    outside = "> " + " ".join(f"other{k}" for k in range(20)) + " the quick brown fox\nhm"
    rows = linked(spark, [(1, 0, "a", TEXT), (1, 1, "b", outside), (2, 0, "a", TEXT), (3, 1, "a", f"> {TEXT}")])
    assert rows[1, 1].reply_to is None and rows[3, 1].reply_to is None


def test_given_conversations_as_mail_link(spark):
    rows = QUERIES["op8_quoted_threads"](spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/conversations.parquet").count()
    assert 3 * sum(r.reply_to is not None for r in rows) >= len(rows)
    assert {len(r.thread.split("/")) for r in rows} >= {1, 2, 3}
    assert not any(">" in line[:2] for r in rows for line in r.body.split("\n"))


def test_odd_turns(spark):
    long_text = " ".join(f"w{k % 5003}" for k in range(40_000))
    turns = [
        (1, 0, None, long_text), (1, 1, "b", "> " + long_text), (1, 1, "b", "> " + long_text), (None, 0, "a", TEXT), (None, 1, "a", f"> {TEXT}"),
        (2, None, "a", TEXT), (2, 5, "b", f"> {TEXT}"), (3, 0, "a", ""), (3, 1, "a", None), (3, 2, "a", ">\n> \n>>"), (4, 0, "a", TEXT), (4, 1, "a", TEXT), (4, 2, "a", f"> {TEXT}"),
    ]
    frame = spark.createDataFrame(turns, SCHEMA)
    for name in ("lines", "level", "key", "n", "original", "path", "body", "keys"):
        frame = frame.withColumn(name, F.lit(1))
    rows = quotations.reply_ordered(frame).collect()
    assert len(rows) == len(turns)
    reply = {(r.conv_id, r.turn): r.reply_to for r in rows}
    assert reply[1, 1] == 0 and reply[4, 2] == 0  # equal originals: the first
    assert all(reply[k] is None for k in ((None, 1), (2, 5), (2, None), (3, 0), (3, 1), (3, 2), (4, 1)))
    assert quotations.reply_ordered(frame.limit(0)).count() == 0

"""Golden cases of the column functions."""

import base64
import gzip

import pytest
from pyspark.sql import functions as F

from strandline.functions import display, events, names, paths, statements, wire


@pytest.fixture()
def value(spark):
    def evaluate(column, **given):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()], F.lit(0).alias("_"))
        return row.select(column.alias("x")).first()["x"]

    return evaluate


def c(name="a"):
    return F.col(name)


@pytest.mark.parametrize(
    "path,ignored",
    [
        ("t/part-0.parquet", False),
        ("t/_SUCCESS", False),
        ("t/_metadata", False),
        ("t/_delta_log/0001.json", False),
        ("t/_temporary/0/part-0", True),
        ("t/.hive-staging_x/part-0", True),
        ("t/-ext-10000/f", True),
        ("t/x-hive-staging/f", True),
        ("a/lost+found/f", True),
        ("a/x.tmp/f", True),
        ("a/.hidden", True),
        ("a/F.TMP", True),
        ("a/b~", True),
        ("a/f._COPYING_", True),
        ("a/_tmp1", True),
        ("a/f.csv._staging_ab-1", True),
        ("a/f.csv._staging_", False),
        ("hdfs://nn:8020/wh/_x/f", True),
        ("a\\_x\\f", True),
        ("a/Thumbs.db", True),
        ("", False),
    ],
)
def test_ignored_path(value, path, ignored):
    assert value(paths.is_ignored_path(c()), a=path) is ignored


@pytest.mark.parametrize(
    "path,want",
    [
        ("hdfs://nn:9000/wh/db.db/", "/wh/db.db"),
        ("wh/x", "/wh/x"),
        ("/", "/"),
        ("", "/"),
        ("hdfs://nn", "/"),
        ("//a", "//a"),
        (" /a// ", "/a"),
    ],
)
def test_path_of(value, path, want):
    assert value(paths.path_of(c()), a=path) == want


def test_prefix_has_a_boundary(value):
    under = lambda p, r: value(paths.under_path(c("p"), c("r")), p=p, r=r)
    assert under("/wh/db.db/t", "hdfs://nn:9000/wh/db.db/")
    assert under("/wh/db.db", "/wh/db.db")
    assert not under("/wh/db.dbx/t", "/wh/db.db")
    assert under("/any", "/")
    depth = lambda p, r: value(paths.depth_under(c("p"), c("r")), p=p, r=r)
    assert (depth("/wh/a/b", "/wh"), depth("/wh", "/wh"), depth("/x", "/wh"), depth("/a/b", "/")) == (2, 0, -1, 2)


@pytest.mark.parametrize(
    "file,src,dst,want",
    [
        ("/wh/db/t/f", "hdfs://nn/wh/db/", "hdfs://dr:9/m/", "hdfs://dr:9/m/t/f"),
        ("/wh/db", "/wh/db", "/m", "/m"),
        ("/a/b", "/", "/m", "/m/a/b"),
        ("/a/b", "/x", "m", "/m/b"),
        ("/a/b", "/a", "/", "/b"),
    ],
)
def test_target_path(value, file, src, dst, want):
    assert value(paths.target_path(c("f"), c("s"), c("d")), f=file, s=src, d=dst) == want


def test_ancestors(value):
    assert value(paths.ancestors(c()), a="/a/b/c") == ["/a", "/a/b", "/a/b/c"]
    assert value(paths.ancestors(c()), a="/") == ["/"]
    assert value(paths.dotted_ancestors(c()), a="root.x.y") == ["root", "root.x", "root.x.y"]


@pytest.mark.parametrize(
    "name,want",
    [
        ("dt=2024-01-01/h=05", ["2024-01-01", "05"]),
        ("k=a%2Fb", ["a/b"]),
        ("k=a+b", ["a+b"]),
        ("k=%zz/x=%41%q", ["%zz", "A%q"]),
        ("k=50%", ["50%"]),
        ("k=%e9", ["é"]),
        ("plain", ["plain"]),
        ("k=a=b", ["a=b"]),
    ],
)
def test_partition_values(value, name, want):
    assert value(paths.partition_values(c()), a=name) == want


def test_partition_name(value):
    keys = F.array(F.lit("dt"), F.lit("h"))
    assert value(paths.partition_name(keys, F.array(F.lit("1"), F.lit("2")))) == "dt=1/h=2"
    assert value(paths.partition_name(keys, F.array(F.lit("1")))) == "1"


def test_up_to_date(value):
    def fresh(exists, ss, sm, ts, tm):
        return value(paths.is_up_to_date(c("e"), c("ss"), c("sm"), c("ts"), c("tm")), e=exists, ss=ss, sm=sm, ts=ts, tm=tm)

    assert fresh(True, 10, 5, 10, 5)
    assert not fresh(True, 10, 6, 10, 5)
    assert fresh(True, 10, 6, 10, 0)
    assert not fresh(True, 0, 5, 0, 5)
    assert not fresh(False, 10, 5, 10, 5)


def headers(*pairs):
    return F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v.encode()).alias("value")) for k, v in pairs])


def test_loop_filter(value):
    keep = lambda *h, **kw: value(wire.should_replicate(headers(("x", "1"), *h), "dc1", "dc2", **kw))
    assert keep()
    assert not keep(("X-Repl-Origin", " DC1 "))
    assert not keep(("X-Repl-Origin", "dc2"))
    assert keep(("X-Repl-Origin", "dc1"), ("X-Repl-Origin", "dc3"))
    assert keep(("X-Repl-Hop", "2"))
    assert not keep(("X-Repl-Hop", "3"))
    assert keep(("X-Repl-Hop", "junk"))
    assert keep(("x-repl-hop", "9"))
    assert not keep(("X-Repl-Hop", "1"), max_hops=1)


def test_headers_are_enriched(value):
    def shown(h):
        got = value(wire.enrich_headers(h, "dc1"))
        return [(r["key"], bytes(r["value"]).decode()) for r in got]

    assert shown(headers(("a", "1"))) == [("a", "1"), ("X-Repl-Origin", "dc1"), ("X-Repl-Hop", "1")]
    assert shown(headers(("x-repl-origin", "dc3"), ("X-Repl-Hop", "1"), ("a", "1"))) == [
        ("X-Repl-Origin", "dc3"),
        ("a", "1"),
        ("X-Repl-Hop", "2"),
    ]
    assert shown(F.lit(None).cast(wire.HEADERS_TYPE)) == [("X-Repl-Origin", "dc1"), ("X-Repl-Hop", "1")]


def test_payload_formats(value):
    kind = lambda v, conf="AUTO_DETECT": value(wire.classify_payload(F.lit(v), conf))
    assert kind(None) == kind(b"") == kind(b"\x00\x00\x00\x01") == wire.PASSTHROUGH
    assert kind(b"\x00\x00\x00\x00\x01") == wire.CONFLUENT
    assert kind(b"\x02" + bytes(8)) == kind(b"\x03" + bytes(8)) == wire.HWX
    assert kind(b"\x02" + bytes(7)) == kind(b"{json}") == wire.PASSTHROUGH
    assert kind(b"{json}", wire.HWX) == wire.HWX
    assert kind(b"\x00" * 9, wire.PASSTHROUGH) == wire.PASSTHROUGH


@pytest.mark.parametrize(
    "data,src,dst,new,want",
    [
        (b"\x00\x00\x00\x00\x07body", wire.CONFLUENT, wire.CONFLUENT, 258, b"\x00\x00\x00\x01\x02body"),
        (b"\x02" + (7).to_bytes(8, "big") + b"body", wire.HWX, wire.CONFLUENT, 9, b"\x00\x00\x00\x00\x09body"),
        (b"\x00\x00\x00\x00\x07body", wire.CONFLUENT, wire.HWX, 9, b"\x02" + (9).to_bytes(8, "big") + b"body"),
        (b"\x03" + (7).to_bytes(8, "big") + b"b", wire.HWX, wire.HWX, 5, b"\x03" + (5).to_bytes(8, "big") + b"b"),
        (b"\x02short", wire.HWX, wire.CONFLUENT, 9, b"\x02short"),
        (b"text", wire.PASSTHROUGH, wire.CONFLUENT, 9, b"text"),
        (None, wire.CONFLUENT, wire.CONFLUENT, 9, None),
    ],
)
def test_transcode(value, data, src, dst, new, want):
    got = value(wire.transcode(F.lit(data).cast("binary"), F.lit(src), dst, F.lit(new)))
    assert (None if got is None else bytes(got)) == want


def test_schema_ids_are_signed(value):
    assert value(wire.schema_id(F.lit(b"\x00\xff\xff\xff\xfe"), F.lit(wire.CONFLUENT))) == -2
    assert value(wire.schema_id(F.lit(b"\x02" + b"\xff" * 8), F.lit(wire.HWX))) == -1
    assert value(wire.schema_id(F.lit(b"\x02" + (2**40).to_bytes(8, "big")), F.lit(wire.HWX))) == 2**40


def test_event_body(spark):
    packed = base64.b64encode(gzip.compress("тело".encode())).decode()
    df = spark.createDataFrame([(packed, "gzip(json-2.0)"), ("plain", "json-0.2"), ("x!", "gzip"), ("p", None)], "m string, f string")
    assert [r[0] for r in df.select(events.event_body(c("m"), c("f"))).collect()] == ["тело", "plain", None, "p"]


@pytest.mark.parametrize(
    "body,want",
    [
        ('{"partitions":[{"values":["a","1"]},{"values":["b","2"]}]}', [["a", "1"], ["b", "2"]]),
        ('{"partitions":[{"dt":"a","h":"1"}]}', [["a", "1"]]),
        ('{"keyValues":{"dt":"a"}}', [["a"]]),
        ('{"values":["a"]}', [["a"]]),
        ('{"partition":{"values":["a"]}}', [["a"]]),
        ('{"partitionValues":[["a","b"],"c"]}', [["a", "b"], ["c"]]),
        ('{"partitions":[]}', []),
        ("not json", []),
    ],
)
def test_event_partition_values(value, body, want):
    assert value(events.event_partition_values(c()), a=body) == want


def test_event_insert(value):
    body = '{"ptnObjJson":"{\\"1\\":{\\"lst\\":[\\"str\\",2,\\"2024\\",\\"x\\"]}}","files":["hdfs://n/a/f1###c","f2",null,"z/f1"],"replace":"TRUE"}'
    got = value(events.event_insert(c()), a=body)
    assert (got["values"], got["files"], got["replace"]) == (["2024", "x"], ["f1", "f2"], True)
    got = value(events.event_insert(c()), a='{"partKeyVals":{"dt":"1"},"replace":false}')
    assert (got["values"], got["files"], got["replace"]) == (["1"], [], False)


def test_event_rename(value):
    table = lambda n: '{\\"1\\":{\\"str\\":\\"' + n + '\\"}}'
    body = lambda a, b: f'{{"tableObjBeforeJson":"{table(a)}","tableObjAfterJson":"{table(b)}"}}'
    assert value(events.event_rename(c()), a=body("t", "u")).asDict() == {"before": "t", "after": "u", "is_rename": True}
    assert value(events.event_rename(c())["is_rename"], a=body("t", "T")) is False
    assert value(events.event_rename(c())["is_rename"], a="{}") is False


def test_names(value):
    assert value(names.norm_id(c()), a="Nn-Prod_1") == "nnprod1"
    assert value(names.local_part(c()), a="User@R") == "user"
    assert value(names.local_part(c()), a="@R") == "@r"
    assert value(names.match_names(c(), "orders.*", ".*-dlq"), a="orders-1") is True
    assert value(names.match_names(c(), "orders.*", ".*-dlq"), a="orders-dlq") is False
    assert value(names.match_names(c(), "", None), a="x") is False
    assert value(names.match_names(c(), "*", ""), a="x") is True
    assert value(names.match_names(c(), "a(", None), a="a(") is False
    assert value(names.match_table(c(), "sales_?"), a="SALES_1") is True
    assert value(names.match_table(c(), "*_x"), a="a_x") is True
    assert value(names.match_table(c(), "a|b"), a="ab") is False
    assert value(names.excluded_group(c()), a=" connect-x ") is True
    assert value(names.excluded_group(c()), a="app") is False
    assert value(names.excluded_group(c()), a="  ") is True


def test_display(value):
    assert [value(display.fmt_size(F.lit(n))) for n in (5, 1536, 1280, 5 << 20, 3 << 30)] == [
        "5 B",
        "1.5 KB",
        "1.3 KB",
        "5.0 MB",
        "3.00 GB",
    ]
    assert [value(display.fmt_memory(F.lit(n))) for n in (500, 2048, 1536, 1586, 3 << 20)] == [
        "500 MB",
        "2 GB",
        "1.50 GB",
        "1.55 GB",
        "3 TB",
    ]
    assert value(display.fmt_delta(F.lit(1024), F.lit(3072))) == "+2 GB"
    assert value(display.fmt_delta(F.lit(3072), F.lit(3000))) == "-72 MB"
    assert value(display.fmt_delta(F.lit(1), F.lit(1))) == ""
    assert value(display.binary_preview(F.lit(b"\x01\xab"))) == "0x01ab"
    assert value(display.binary_preview(F.lit(bytes(70)))) == "0x" + "00" * 64 + "... (70 bytes)"
    assert value(display.progress_percent(F.lit(300), F.lit(200))) == 100.0
    assert value(display.progress_percent(F.lit(1), F.lit(3))) == 33.33
    assert value(display.split_issues(F.lit("a; b;; c "))) == ["a", "b", "c"]


def test_statements(value):
    sql = "select * from a.b join c"
    assert value(statements.referenced_tables(c()), a=sql) == ["a.b", "c"]
    assert value(statements.referenced_tables(c()), a="show tables") == ["unknown_table"]
    flags = value(statements.lint_flags(c()), a=sql)
    assert flags == [statements.STAR_RULE, statements.JOIN_RULE]
    assert value(statements.lint_score(statements.lint_flags(c())), a=sql) == 5
    assert value(statements.query_operations(c()), a="select 1") == ["SCAN"]

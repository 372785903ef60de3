"""Registered queries over the given tables, one per operator, with oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm import (
    collocations,
    decontaminate,
    licenses,
    line_dedup,
    mixing,
    near_duplicates,
    neighbours,
    periodic,
    quality,
    quotations,
    rules,
    toxicity,
    warc,
)
from strandline.llm.tables import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"), width=2, share=0.8)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents")).drop("n_notices")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted", "n_words", "n_significant"
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, read(spark, sf_dir, "pages"))


def _threads(turns: DataFrame) -> DataFrame:
    found = quotations.reply_ordered(turns)
    thread = F.array_join(F.col("path").cast("array<string>"), "/").alias("thread")
    return found.select("conv_id", "turn", "role", "reply_to", thread, "n_quoted", "n_linked", "body")


def op8_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _threads(read(spark, sf_dir, "conversations"))


def op8_quoted_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given conversations as mail: each turn quotes the one before, wrapped anew, and that one's quote below it."""
    return _threads(as_mail(read(spark, sf_dir, "conversations")))


def as_mail(turns: DataFrame) -> DataFrame:
    """Every turn but the first of a conversation quotes the turn before it in lines of six words; every third turn only deeper."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    wrapped = lambda text, marks: F.concat(F.lit(marks), F.regexp_replace(text, "((?:[^ ]+ ){5}[^ ]+) ", f"$1\n{marks}"), F.lit("\n"))
    told = turns.select("conv_id", "turn", "role", flat.alias("flat"))
    told = told.withColumn("last", F.lag("flat").over(order)).withColumn("before", F.lag("flat", 2).over(order))
    first = F.when(F.col("last").isNotNull() & (F.col("turn") % 3 != 2), F.concat(F.lit("Ann wrote:\n"), wrapped(F.col("last"), "> ")))
    second = F.when(F.col("before").isNotNull(), F.concat(F.lit("> Bo wrote:\n"), wrapped(F.col("before"), ">> ")))
    none = F.lit("")
    return told.select("conv_id", "turn", "role", F.concat(F.coalesce(first, none), F.coalesce(second, none), "flat").alias("text"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_report(read(spark, sf_dir, "documents"), share=0.8)
    return found.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(read(spark, sf_dir, "documents"), plant=True).drop("runs", "collapsed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_near_duplicates, op3_quality_classifier, op4_license_scan, op5_source_mix,
        op6_toxicity, op7_warc, op8_quotation_links, op8_quoted_threads, op9_decontamination, op10_line_dedup,
        op11_neighbours, op12_collocations, op13_periodic_runs,
    )
}

_PLAIN = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_BUCKET = "CASE WHEN {v} < 512 THEN {v} ELSE (length(bin({v})) - 9) * 256 + ({v} >> (length(bin({v})) - 9)) END"


def _fence_sql(rows: str, learns: dict[str, str], tails: tuple[int, int, int, int, int], x: str) -> str:
    """Views ``cell_x`` to ``fenced_x``: ``rows`` with a column ``<metric>_in`` for each metric."""
    cells = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS metric, {_BUCKET.format(v=m)} AS bucket, count(*) AS n FROM {rows} WHERE NOT base_failed AND {learns[m]} GROUP BY ALL"
        for m in rules.METRICS
    )
    a, b, c, d, reach = tails
    quantile = lambda percent, bound: f"min(CASE WHEN upto * 100 >= total * {percent} THEN {bound} END)"
    low, high = "(bucket - e * 256) << e", "((bucket - e * 256 + 1) << e) - 1"
    within, joins = [], []
    for m, share in rules.METRICS.items():
        expected = share and f"((r.{share[1]} * {m}.high)::DOUBLE / 1000000::DOUBLE)"
        test = (
            f"r.{share[0]}::DOUBLE <= {expected} + {rules.CHANCE}::DOUBLE * sqrt({expected}) + {rules.CHANCE**2}::DOUBLE"
            if share else f"r.{m} BETWEEN {m}.low AND {m}.high"
        )
        within.append(f"coalesce({test}, true) AS {m}_in")
        joins.append(
            f"LEFT JOIN fence_{x} AS {m} ON {m}.lang IS NOT DISTINCT FROM r.lang AND {m}.source IS NOT DISTINCT FROM r.source AND {m}.metric = '{m}'"
        )
    pick = lambda y: f"CASE WHEN a.total >= {rules.CELL_TEXTS} THEN a.{y} WHEN b.total >= {rules.CELL_TEXTS} THEN b.{y} ELSE c.{y} END AS {y}"
    return f"""cell_{x} AS ({cells}), level_{x} AS (
  SELECT 0 AS level, lang, source, metric, bucket, n FROM cell_{x}
  UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM cell_{x} GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, metric, bucket, sum(n) FROM cell_{x} GROUP BY ALL
), placed_{x} AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, metric) AS total,
    CASE WHEN bucket < 512 THEN 0 ELSE bucket // 256 - 1 END AS e
  FROM level_{x}
), quantile_{x} AS (
  SELECT level, lang, source, metric, max(total) AS total,
    {quantile(a, low)} AS a, {quantile(b, low)} AS b, {quantile(c, high)} AS c, {quantile(d, high)} AS d
  FROM placed_{x} GROUP BY level, lang, source, metric
), bound_{x} AS (
  SELECT *, a - {reach} * (b - a) AS low, d + {reach} * (d - c) AS high FROM quantile_{x}
), fence_{x} AS (
  SELECT k.lang, k.source, k.metric, {pick("low")}, {pick("high")}
  FROM (SELECT DISTINCT lang, source, metric FROM cell_1) k
  LEFT JOIN (FROM bound_{x} WHERE level = 0) a
    ON a.lang IS NOT DISTINCT FROM k.lang AND a.source IS NOT DISTINCT FROM k.source AND a.metric = k.metric
  LEFT JOIN (FROM bound_{x} WHERE level = 1) b ON b.lang IS NOT DISTINCT FROM k.lang AND b.metric = k.metric
  LEFT JOIN (FROM bound_{x} WHERE level = 2) c ON c.metric = k.metric
), fenced_{x} AS (
  SELECT r.*, {", ".join(within)} FROM m r {" ".join(joins)}
)"""


def _rules_sql() -> str:
    first = _fence_sql("m", {m: "true" for m in rules.METRICS}, rules.FIRST, "1")
    others = {m: " AND ".join(f"{o}_in" for o in rules.METRICS if o != m) for m in rules.METRICS}
    last = _fence_sql("fenced_1", others, rules.LAST, "2")
    return rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_PLAIN}) AS w FROM documents
), win_at AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)
), again AS (
  SELECT doc_id, g FROM win_at GROUP BY ALL HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM win_at JOIN again USING (doc_id, g), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), line AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT line) AS distinct_n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), c AS (
  SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(line.n, 0)::BIGINT AS n_lines, coalesce(line.n - distinct_n, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN line USING (doc_id) LEFT JOIN covered USING (doc_id)
), share AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CAST(floor(coalesce(word_chars * 1000.0::DOUBLE / nullif(n_words, 0), 0)) AS BIGINT) AS word_length,
    CAST(floor(coalesce(n_symbols * 1000000.0::DOUBLE / nullif(word_chars, 0), 0)) AS BIGINT) AS symbol_share,
    CAST(floor(coalesce(n_repeat_words * 1000000.0::DOUBLE / nullif(n_words, 0), 0)) AS BIGINT) AS repeat_share,
    CAST(floor(coalesce(n_dup_lines * 1000000.0::DOUBLE / nullif(n_lines, 0), 0)) AS BIGINT) AS dup_line_share
  FROM c
), m AS (SELECT * FROM share), {first}, {last}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"{m}_in" for m in rules.METRICS)} AS kept
FROM fenced_2
"""


_NEAR_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, {_PLAIN}) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                               WHEN len(w) = 1 THEN [w[1]] ELSE [] END) AS g FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id > b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(least.b, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""


def _license_sql() -> str:
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, i, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) "
        f"WHERE array_to_string(w[i:i + {len(p.split()) - 1}], ' ') = '{p}'"
        for p, label in licenses.PHRASES.items()
    )
    templates = " UNION ALL ".join(f"SELECT {k} AS t, '{label}' AS label, {licenses.SPREAD * len(text.split())} AS width, '{text}' AS body" for k, (label, text) in enumerate(licenses.TEMPLATES))
    return rf"""
WITH d AS (SELECT doc_id, {_LOWER} AS t, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents
), base AS ({phrases}
), template AS ({templates}
), word AS (SELECT DISTINCT t, label, unnest(string_split(body, ' ')) AS x FROM template
), need AS (SELECT t, count(*) AS m, any_value(width) AS width FROM word JOIN template USING (t) GROUP BY 1
), place AS (
  SELECT doc_id, t, label, m, width, i, x FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) JOIN word USING (x) JOIN need USING (t)
), able AS (
  SELECT doc_id, t FROM place GROUP BY doc_id, t, m HAVING count(DISTINCT x) >= (m * {licenses.CONTAINED} + 99) // 100
), found AS (
  SELECT a.doc_id, a.t, a.label, a.i, a.m, a.width, count(DISTINCT b.x) AS c
  FROM place a JOIN able USING (doc_id, t) JOIN place b ON a.doc_id = b.doc_id AND a.t = b.t AND b.i >= a.i AND b.i < a.i + a.width GROUP BY ALL
), more AS (
  SELECT doc_id, label, c::DOUBLE / m AS share FROM found WHERE c >= (m * {licenses.CONTAINED} + 99) // 100
), b AS (
  SELECT doc_id, count(*) AS n, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM base GROUP BY 1
), a AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM more) GROUP BY 1
), s AS (SELECT doc_id, max(share) AS share FROM more GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)
"""


_MIX_SQL = rf"""
WITH f AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_PLAIN}))::BIGINT AS size, coalesce(text, '') AS t,
    (('0x' || substr(md5('mix ' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / pow(2.0, 52) AS u
  FROM documents
), q AS (
  SELECT doc_id, source, size, -ln(u) / greatest(0.05::DOUBLE,
    (1 - 10 * (length(t) - length(translate(t, '#*$%&|<>!', ''))) / greatest(length(t), 1)::DOUBLE) * least(1.0::DOUBLE, size / 50::DOUBLE)) AS key
  FROM f
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM q GROUP BY 1
), o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s
), w AS (SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM o
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight::DOUBLE, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM w
), p AS (
  SELECT source, source_size, least(cap::DOUBLE,
    (SELECT level FROM l WHERE level <= cap / weight::DOUBLE ORDER BY cap / weight::DOUBLE, place LIMIT 1) * weight) AS target FROM l
), b AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM p
), r AS (
  SELECT q.doc_id, size, source_size, target, epochs, budget - epochs * source_size AS rest,
    sum(size) OVER (PARTITION BY q.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM q JOIN b ON q.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, rest - before)))::BIGINT AS taken FROM r
"""

_WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

_MAIL_SQL = r"""
SELECT conv_id, turn, role,
  CASE WHEN last IS NOT NULL AND turn % 3 <> 2 THEN 'Ann wrote:' || chr(10) || '> ' || regexp_replace(last, '((?:[^ ]+ ){5}[^ ]+) ', '\1' || chr(10) || '> ', 'g') || chr(10) ELSE '' END
  || CASE WHEN before IS NOT NULL THEN '> Bo wrote:' || chr(10) || '>> ' || regexp_replace(before, '((?:[^ ]+ ){5}[^ ]+) ', '\1' || chr(10) || '>> ', 'g') || chr(10) ELSE '' END
  || flat AS text
FROM (SELECT *, lag(flat) OVER (PARTITION BY conv_id ORDER BY turn) AS last, lag(flat, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS before
      FROM (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS flat FROM conversations))
"""


def _quote_sql(turns: str) -> str:
    return r"""
WITH RECURSIVE given AS (__TURNS__), cut AS (
  SELECT conv_id, turn, role, unnest(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))) AS body,
    generate_subscripts(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), 1) AS i
  FROM given
), lv AS (
  SELECT *, length(translate(regexp_extract(body, '^(?:[ \t]*>)+'), ' ' || chr(9), '')) AS level,
    list_filter(regexp_split_to_array(translate(regexp_replace(body, '^(?:[ \t]*>)+', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM cut
), x AS (
  SELECT *, regexp_matches(body, 'wrote:[ \t]*$') AND coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i), 0) > level AS attribution FROM lv
), passage AS (
  SELECT conv_id, turn, level, flatten(list(w ORDER BY i)) AS w FROM x WHERE NOT attribution GROUP BY 1, 2, 3
), run AS (
  SELECT DISTINCT conv_id, turn, level, array_to_string(w[k:k + least(len(w), __SHINGLE__) - 1], ' ') AS key
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), __SHINGLE__) + 2)) AS k FROM passage WHERE len(w) > 0)
  UNION SELECT conv_id, turn, level, array_to_string(w, ' ') FROM x WHERE level = 0 AND NOT attribution AND len(w) BETWEEN 1 AND __SHINGLE__ - 1
), quoted AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn, level) AS n FROM run WHERE level > 0
), own AS (SELECT conv_id, key, min(turn) AS original FROM run WHERE level = 0 GROUP BY 1, 2
), votes AS (
  SELECT conv_id, turn, level, n, original, count(*) AS n_linked FROM quoted JOIN own USING (conv_id, key) WHERE original < turn GROUP BY 1, 2, 3, 4, 5
  HAVING 4 * count(*) >= n
), link AS (
  SELECT conv_id, turn, original AS reply_to, n_linked FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n_linked DESC, original DESC) = 1
), path AS (
  SELECT conv_id, turn, reply_to || '/' || turn AS thread FROM link l
  WHERE NOT EXISTS (SELECT 1 FROM link z WHERE z.conv_id = l.conv_id AND z.turn = l.reply_to)
  UNION ALL SELECT l.conv_id, l.turn, p.thread || '/' || l.turn FROM path p JOIN link l ON l.conv_id = p.conv_id AND l.reply_to = p.turn
), body AS (
  SELECT conv_id, turn, any_value(role) AS role, count(*) FILTER (level > 0)::BIGINT AS n_quoted,
    coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0 AND NOT attribution), '') AS body
  FROM x GROUP BY 1, 2
)
SELECT b.conv_id, b.turn, role, reply_to, coalesce(thread, b.turn::VARCHAR) AS thread, n_quoted, coalesce(n_linked, 0)::BIGINT AS n_linked,
  regexp_replace(body, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body
FROM body b LEFT JOIN link USING (conv_id, turn) LEFT JOIN path USING (conv_id, turn)
""".replace("__TURNS__", turns).replace("__SHINGLE__", str(quotations.SHINGLE))


_BENCHMARK_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents
), b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (
    SELECT item_id, w, least(len(w), {decontaminate.WINDOW}) AS size, unnest(range(1, len(w) - least(len(w), {decontaminate.WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM win
), win_at AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), hit AS (SELECT doc_id, item_id, i, size FROM win_at JOIN win USING (size, g)
), words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY 1
), items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_LINE_SQL = rf"""
WITH line AS (
  SELECT doc_id, unnest(string_split({_LOWER}, chr(10))) AS t, generate_subscripts(string_split({_LOWER}, chr(10)), 1) - 1 AS k
  FROM documents WHERE text IS NOT NULL
), own AS (
  SELECT doc_id, k, list_sort(list_distinct(regexp_extract_all(t, {_PLAIN}))) AS s FROM line
), with_words AS (SELECT * FROM own WHERE len(s) > 0
), sets AS (SELECT row_number() OVER () AS id, s, len(s) AS n, min((doc_id, k)) AS place FROM with_words GROUP BY s
), word AS (SELECT id, n, place, unnest(s) AS w FROM sets
), often AS (SELECT w, count(*) AS c FROM word GROUP BY 1
), prefix AS (
  SELECT id, n, place, w FROM (SELECT word.*, row_number() OVER (PARTITION BY id ORDER BY c, w) AS r FROM word JOIN often USING (w))
  WHERE r <= n - (n * 80 + 99) // 100 + 1
), cand AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.w = b.w AND b.place < a.place
  WHERE least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
), near AS (
  SELECT DISTINCT x.id FROM cand JOIN sets x ON x.id = a JOIN sets y ON y.id = b
  WHERE len(list_intersect(x.s, y.s)) * 180 >= (x.n + y.n) * 80
), gone AS (
  SELECT doc_id, k FROM with_words JOIN sets USING (s) WHERE (doc_id, k) > place OR id IN (SELECT id FROM near)
), per AS (SELECT doc_id, count(*) AS n, string_agg(k::VARCHAR, ',' ORDER BY k) AS ks FROM gone GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
  coalesce(n, 0)::BIGINT AS n_removed, coalesce(ks, '') AS removed
FROM documents LEFT JOIN per USING (doc_id)
"""

_PHRASE_SQL = rf"""
WITH piece AS (
  SELECT coalesce(lang, '{collocations.UNDETERMINED}') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece
), total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1
), gram AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {collocations.LONGEST + 1}) size(k) WHERE len(w) >= k)
), f AS (SELECT lang, k, phrase, count(*) AS a FROM gram GROUP BY ALL HAVING count(*) >= {collocations.LEAST}
), cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), cut AS (
  SELECT lang, phrase, a, j, array_to_string(w[:j], ' ') AS front, array_to_string(w[j + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)
), scored AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM cut c JOIN f l ON l.lang = c.lang AND l.phrase = front JOIN f r ON r.lang = c.lang AND r.phrase = rest JOIN total ON total.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1
), inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM scored LEFT JOIN inside USING (lang, phrase) WHERE around IS NULL OR 100 * around < {collocations.SHARE} * a
QUALIFY rank <= {collocations.TOP}
"""

_RUN_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), {_PLAIN}) AS w,
    CASE WHEN doc_id IS NOT NULL THEN xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda h, c: CASE WHEN c < 0 THEN xor(h >> 1, 3988292384::BIGINT * (h & 1)) ELSE xor(h, c) END)) END AS h
  FROM documents
), p AS (SELECT *, len(w) AS n, h // 10 % greatest(len(w), 1) AS a, h // 10 % 8 AS e FROM d
), x AS (
  SELECT id, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN w[:a] || list_transform(range(a, n), lambda i: w[a + (i - a) % (1 + (n - a) // (3 + e)) + 1]) ELSE w END AS w FROM p
), word AS (SELECT id, n, unnest(w) AS word, unnest(range(n)) AS i FROM x
), pair AS (
  SELECT l.id, l.i, r.i - l.i AS q FROM word l JOIN word r ON l.id = r.id AND l.word = r.word AND r.i > l.i AND 3 * (r.i - l.i) <= l.n
), stretch AS (
  SELECT id, min(i) AS start, count(*) + q AS length, q
  FROM (SELECT *, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM pair)
  GROUP BY id, q, island HAVING count(*) + q >= greatest({periodic.LEAST}, {periodic.EXPONENT} * q)
), run AS (SELECT id, start, length, min(q) AS period FROM stretch GROUP BY ALL
), per AS (
  SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM run GROUP BY id
), best AS (
  SELECT * FROM run a WHERE NOT EXISTS (SELECT 1 FROM run b WHERE b.id = a.id AND (b.length * a.period > a.length * b.period
    OR b.length * a.period = a.length * b.period AND (b.start < a.start OR b.start = a.start AND b.period < a.period)))
), kept AS (
  SELECT id, string_agg(word, ' ' ORDER BY i) AS t FROM word
  WHERE NOT EXISTS (SELECT 1 FROM run WHERE run.id = word.id AND word.i >= start + period AND word.i < start + length) GROUP BY id
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM x LEFT JOIN per USING (id) LEFT JOIN best USING (id) LEFT JOIN kept USING (id)
"""

ORACLES: dict[str, str] = {
    "op1_quality_rules": _rules_sql(),
    "op2_near_duplicates": _NEAR_SQL,
    "op4_license_scan": _license_sql(),
    "op5_source_mix": _MIX_SQL,
    "op7_warc": _WARC_SQL,
    "op8_quotation_links": _quote_sql("SELECT * FROM conversations"),
    "op8_quoted_threads": _quote_sql(_MAIL_SQL),
    "op9_decontamination": _BENCHMARK_SQL,
    "op10_line_dedup": _LINE_SQL,
    "op12_collocations": _PHRASE_SQL,
    "op13_periodic_runs": _RUN_SQL,
}

"""Operational tables derived from the given ones.

One text per table, in the subset of SQL that Spark and DuckDB share, so both
sides of a check derive exactly the same rows.  ``{name}`` refers to a given
table or to another derived one.  ``epoch_us`` is the only function that is
spelled differently in Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import scratch_path

GIVEN = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

#: The moment time-dependent queries are asked at, in epoch seconds.
NOW_S = 1_706_659_200  # 2024-01-31 00:00:00
ORDERS_NOW_S = 1_009_843_200  # 2002-01-01 00:00:00

#: Size of a row group in a file that is a micro-batch of its own.
ROW_GROUP_BYTES = 1 << 20

FIXTURES: dict[str, str] = {
    "jobs": """
        SELECT o_orderkey AS id, o_custkey AS parent_id,
               CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
               CAST(floor(o_totalprice * 100) AS BIGINT) AS total_bytes,
               CAST(floor(o_totalprice * 100 * (o_orderkey % 4) / 3) AS BIGINT) AS copied_bytes,
               CAST(floor(epoch_us(o_orderdate) / 1000000) AS BIGINT) AS started_s,
               CASE WHEN o_orderstatus = 'F'
                    THEN CAST(floor(epoch_us(o_orderdate) / 1000000 + o_totalprice) AS BIGINT) END AS completed_s,
               'Cluster-' || (o_custkey % 5) AS source_cluster,
               'cluster_' || (o_orderkey % 5) AS target_cluster,
               '/data/set' || (o_orderkey % 40) AS source_path,
               '/data/set' || (o_custkey % 40) AS target_path,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'STREAMING_INOTIFY' WHEN '2-HIGH' THEN 'BATCH' END AS sync_mode,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'PARTITION_COPY' WHEN '5-LOW' THEN 'Table_Copy'
                    WHEN '3-MEDIUM' THEN 'ROOT' END AS job_type,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'System' WHEN '2-HIGH' THEN 'User' || (o_custkey % 50) || '@LAKE.ORG'
                    WHEN '3-MEDIUM' THEN ' ' WHEN '4-NOT SPECIFIED' THEN 'user' || (o_custkey % 50) END AS created_by,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'User' || (o_orderkey % 50) || '@LAKE.ORG' END AS principal
        FROM {orders}""",
    "tasks": """
        SELECT l_orderkey AS job_id, l_linenumber AS seq, l_partkey AS part_id, l_suppkey AS agent_id,
               CAST(floor(l_extendedprice * 1000) AS BIGINT) AS file_size,
               CAST(floor(l_quantity) AS INT) AS file_count,
               CASE l_returnflag WHEN 'N' THEN 'QUEUED' WHEN 'R' THEN 'SKIPPED' ELSE 'COMPLETED' END AS status,
               CAST(floor(epoch_us(l_shipdate) / 1000000) AS BIGINT) AS updated_s
        FROM {lineitem}""",
    "runs": """
        SELECT o_custkey AS job_id, o_orderkey AS run_number,
               CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
               epoch_us(o_orderdate) AS started_us,
               epoch_us(o_orderdate) + CAST(floor(o_totalprice) AS BIGINT) * 1000 - 100000000 AS ended_us,
               CAST(floor(o_totalprice * 1000) AS BIGINT) AS bytes
        FROM {orders}""",
    "parents": """
        SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'PAUSED' WHEN 'MACHINERY' THEN 'STOPPED'
                                ELSE 'ACTIVE' END AS status,
               'Cluster-' || (c_custkey % 5) AS source_cluster, c_name AS name
        FROM {customer}""",
    "source_files": """
        SELECT source || '/' || lang || '/' || doc_id AS rel_path, n_chars AS size, 1700000000 + doc_id AS mtime_s
        FROM {documents}""",
    "target_files": """
        SELECT d.source || '/' || d.lang || '/' || d.doc_id AS rel_path,
               CASE WHEN l.quality = 0 THEN d.n_chars + 1 ELSE d.n_chars END AS size,
               CASE WHEN d.n_chars > 5000 THEN 1700000000 + d.doc_id - 60 WHEN l.quality = 1 THEN 0
                    ELSE 1700000000 + d.doc_id END AS mtime_s
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
        WHERE l.toxic IS NULL OR l.toxic = 0
        UNION ALL
        SELECT 'extra/' || item_id AS rel_path, item_id + 1 AS size, 1700000000 AS mtime_s FROM {benchmark}""",
    "paths": """
        SELECT doc_id, CASE lang WHEN 'de' THEN 'hdfs://nn1:8020/wh/' WHEN 'fr' THEN '/wh/' WHEN 'es' THEN 'wh//' ELSE '/wh' END
            || CASE source WHEN 'src1' THEN '/_temporary/0/' WHEN 'src2' THEN '/.hive-staging_1/' WHEN 'src3' THEN '/-ext-10000/'
                 WHEN 'src4' THEN '/t1/_delta_log/' WHEN 'src5' THEN '/lost+found/' WHEN 'src6' THEN '/x.staging/'
                 WHEN 'src7' THEN '/.Trash/' ELSE '/' || source || '/' END
            || CASE WHEN n_chars < 200 THEN '_SUCCESS' WHEN n_chars < 250 THEN '.part-' || doc_id || '.crc'
                 WHEN n_chars < 300 THEN 'part-' || doc_id || '.parquet' WHEN n_chars < 350 THEN 'f' || doc_id || '.TMP'
                 WHEN n_chars < 400 THEN 'a_COPYING_' || doc_id WHEN n_chars < 450 THEN 'b' || doc_id || '.orc'
                 WHEN n_chars < 500 THEN '_tmp' || doc_id WHEN n_chars < 550 THEN 'f' || doc_id || '._staging_' || doc_id
                 WHEN n_chars < 600 THEN 'note' || doc_id || '.txt~' WHEN n_chars < 700 THEN 'd' || doc_id || '.CSV'
                 WHEN n_chars < 800 THEN 'd' || doc_id || '.inprogress' WHEN n_chars < 1000 THEN 'README.md'
                 WHEN n_chars < 1500 THEN 'blob' || doc_id || '.binary' WHEN n_chars < 2000 THEN 'noext' || doc_id
                 ELSE 'p' || doc_id || '.gz' END AS path,
            n_chars AS size
        FROM {documents}""",
    "locations": """
        SELECT page_id, regexp_replace(url, '[?#].*$', '') AS location FROM {pages}""",
    "records": """
        SELECT 'topic-' || event_type AS topic, CAST(user_id % 8 AS INT) AS part, event_id AS rec_offset,
               CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts_ms, CAST(user_id AS STRING) AS rec_key,
               CASE event_type
                    WHEN 'view' THEN '00' || lpad(hex(event_id % 50), 8, '0') || hex(props)
                    WHEN 'click' THEN '02' || lpad(hex(user_id % 50), 16, '0') || hex(props)
                    WHEN 'signup' THEN '0201'
                    WHEN 'error' THEN NULL ELSE hex(props) END AS payload_hex,
               CASE WHEN value < 5 THEN NULL ELSE 'DC' || (user_id % 5) END AS origin,
               CASE WHEN value < 10 THEN NULL WHEN value < 20 THEN 'bad' ELSE ' ' || (event_id % 6) END AS hop,
               CAST(length(props) + event_id % 97 AS BIGINT) AS size
        FROM {events}""",
    "schema_ids": """
        SELECT 'topic-view' AS topic, CAST(n_nationkey AS BIGINT) AS source_id, CAST(n_nationkey + 1000 AS BIGINT) AS target_id FROM {nation}
        UNION ALL
        SELECT 'topic-click' AS topic, CAST(n_nationkey AS BIGINT) AS source_id, CAST(n_nationkey + 5000 AS BIGINT) AS target_id FROM {nation}""",
    "batches": """
        SELECT CAST(user_id % 8 AS INT) AS part, event_id AS seq, event_id * 10 + 9 AS max_offset,
               event_id * 10 AS prev_max, event_type <> 'error' OR value > 20 AS settled
        FROM {events}""",
    "samples": """
        SELECT user_id AS agent, 'dc' || (user_id % 5) AS site, event_id AS seq,
               CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS ts_s, event_type AS kind,
               CAST(floor(value * 100) AS BIGINT) AS messages, CAST(floor(value) AS BIGINT) AS lag_ms, value
        FROM {events}""",
    "members": """
        SELECT s_name AS agent_id, s_suppkey AS agent_no, CASE WHEN s_nationkey > 20 THEN NULL ELSE 'Cluster-' || s_nationkey END AS cluster_id,
               CAST(floor(s_acctbal) AS BIGINT) AS load, CASE WHEN s_acctbal > 2000 THEN 'online' ELSE 'offline' END AS status,
               'host' || s_suppkey || ':9095' AS address,
               CAST(floor(s_acctbal * 1000) AS BIGINT) AS raw_bytes, CAST(floor(s_acctbal * 400) AS BIGINT) AS packed_bytes,
               CAST(floor(s_acctbal / 3) AS BIGINT) AS chunk_count, s_acctbal / 2 AS latency_ms
        FROM {supplier}""",
    "sites": """
        SELECT 'cluster' || n_nationkey AS site_id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region_no FROM {nation}""",
    "live_queues": """
        SELECT 'root.' || p_brand || '.q' || p_partkey AS path, 'root.' || p_brand AS parent_path, 'q' || p_partkey AS name,
               p_type AS label, CAST(p_size AS DOUBLE) / 2 AS capacity,
               CASE WHEN p_retailprice > 1500 THEN 100.0e0 ELSE CAST(p_size AS DOUBLE) + 20 END AS max_capacity,
               'RUNNING' AS state, 'fifo' AS policy, 'a,b' AS node_labels
        FROM {part}""",
    "draft_queues": """
        SELECT 'root.' || p_brand || '.q' || p_partkey AS path, 'root.' || p_brand AS parent_path, 'q' || p_partkey AS name,
               p_type AS label,
               CASE WHEN p_brand = 'Brand#7' THEN CAST(p_size AS DOUBLE) / 2 + 1.25e0 WHEN p_brand = 'Brand#8' THEN CAST(p_size AS DOUBLE) / 2 + 0.005e0
                    WHEN p_brand = 'Brand#9' THEN -1.0e0 WHEN p_brand = 'Brand#10' THEN 120.0e0 ELSE CAST(p_size AS DOUBLE) / 2 END AS capacity,
               CASE WHEN p_retailprice > 1500 THEN 100.0e0 ELSE CAST(p_size AS DOUBLE) + 20 END AS max_capacity,
               CASE WHEN p_name LIKE 'red%' THEN 'STOPPED' ELSE 'RUNNING' END AS state,
               CASE WHEN p_name LIKE 'blue%' THEN 'fair' WHEN p_name LIKE 'small%' THEN 'utilization' ELSE 'FIFO' END AS policy,
               CASE WHEN p_type = 'LARGE' THEN 'b,a' ELSE 'a' END AS node_labels,
               CASE WHEN p_type = 'PROMO' THEN 'delete' ELSE 'modify' END AS action
        FROM {part} WHERE p_type <> 'SMALL'
        UNION ALL
        SELECT CASE WHEN s_acctbal > 5000 THEN 'root.new.q' || s_suppkey ELSE 'root.Brand#1.n' || s_suppkey END AS path, 'root.new' AS parent_path, 'q' || s_suppkey AS name, 'SMALL' AS label,
               1.0e0 AS capacity, 0.5e0 AS max_capacity, 'RUNNING' AS state, 'fair' AS policy, 'a' AS node_labels,
               CASE WHEN s_acctbal > 1000 THEN 'create' ELSE 'rename' END AS action
        FROM {supplier}""",
    "source_columns": """
        SELECT 'T_' || p_brand AS table_name, 'Col' || p_partkey AS column_name,
               CASE p_type WHEN 'LARGE' THEN 'decimal(10, 2)' WHEN 'PROMO' THEN 'array < int >' WHEN 'SMALL' THEN 'int' ELSE 'string' END AS column_type
        FROM {part}""",
    "target_columns": """
        SELECT 'T_' || p_brand AS table_name, 'col' || p_partkey AS column_name,
               CASE p_type WHEN 'LARGE' THEN 'DECIMAL(10,2)' WHEN 'PROMO' THEN 'array<int>' WHEN 'SMALL' THEN 'bigint' ELSE 'string' END AS column_type
        FROM {part} WHERE p_name NOT LIKE 'red%'
        UNION ALL
        SELECT 'T_Brand#' || (s_suppkey % 25) AS table_name, 'extra' || s_suppkey AS column_name, 'double' AS column_type FROM {supplier}""",
    "source_tables": """
        SELECT 't' || c_custkey AS table_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'EXTERNAL_TABLE' ELSE 'MANAGED_TABLE' END AS table_type,
               CASE WHEN c_mktsegment = 'FURNITURE' THEN 'dt,hour' ELSE 'dt' END AS partition_keys,
               'org.Serde' AS serde, 'org.In' AS input_format, 'org.Out' AS output_format,
               CASE WHEN c_acctbal > 5000 THEN 'TRUE' WHEN c_acctbal > 2000 THEN 'false' END AS transactional
        FROM {customer}""",
    "target_tables": """
        SELECT 't' || c_custkey AS table_name, CASE WHEN c_acctbal < 0 THEN 'EXTERNAL_TABLE' ELSE 'MANAGED_TABLE' END AS table_type,
               'dt' AS partition_keys, CASE WHEN c_nationkey = 3 THEN NULL WHEN c_nationkey = 4 THEN 'org.Other' ELSE 'ORG.serde' END AS serde,
               CASE WHEN c_nationkey = 5 THEN 'x.In' ELSE 'org.In' END AS input_format, 'org.Out' AS output_format
        FROM {customer} WHERE c_mktsegment <> 'AUTOMOBILE'
        UNION ALL
        SELECT 's' || s_suppkey AS table_name, 'MANAGED_TABLE' AS table_type, 'dt' AS partition_keys, 'org.Serde' AS serde,
               'org.In' AS input_format, 'org.Out' AS output_format
        FROM {supplier}""",
    "partitions_src": """
        SELECT 'db' || n.n_regionkey AS db, 't' || c.c_nationkey AS table_name, 'k=' || c.c_custkey || '/seg=' || c.c_mktsegment AS part_name,
               '/wh/' || c.c_nationkey || '/' || c.c_custkey AS location
        FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "partitions_tgt": """
        SELECT 'db' || n.n_regionkey AS db, 't' || c.c_nationkey AS table_name, 'k=' || c.c_custkey || '/seg=' || c.c_mktsegment AS part_name
        FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 1000
        UNION ALL
        SELECT 'db0' AS db, 't' || s_nationkey AS table_name, 'k=' || s_suppkey || '/seg=OLD%20' || s_nationkey AS part_name FROM {supplier}""",
    "topic_jobs": """
        SELECT event_id AS id, 'dc' || (user_id % 7) AS source_dc, 'DC' || (event_id % 7) AS target_dc,
               CASE WHEN event_type = 'click' THEN 'BIDIRECTIONAL' ELSE 'ONE_WAY' END AS direction,
               CASE WHEN event_type = 'error' THEN 'PAUSED' WHEN event_type = 'view' THEN 'active' ELSE 'ACTIVE' END AS status,
               't' || user_id || ',u' || user_id || ',x' || event_id AS topics,
               CAST(floor(value * 100) AS BIGINT) AS messages, CAST(floor(value) AS BIGINT) AS lag_ms
        FROM {events}""",
    "fs_journal": """
        SELECT event_id AS txid,
               CASE event_type WHEN 'view' THEN 'CLOSE' WHEN 'error' THEN 'UNLINK' ELSE 'RENAME' END AS op,
               CASE WHEN event_type IN ('view', 'error') THEN '/wh/db' || (user_id % 30) || '.db/t' || (user_id % 9) ||
                         CASE WHEN value < 2 THEN '/_temporary/f' WHEN value < 50 THEN '/f' || (event_id % 40) ELSE '' END END AS path,
               CASE event_type WHEN 'click' THEN '/wh/db' || (user_id % 30) || '.db/.hive-staging/f' || (event_id % 40)
                         WHEN 'purchase' THEN '/wh/db' || (user_id % 30) || '.db/t1/f' || (event_id % 40)
                         WHEN 'signup' THEN '/wh/db' || (user_id % 30) || '.db/t2' END AS src,
               CASE event_type WHEN 'click' THEN '/wh/db' || (user_id % 30) || '.db/t3/f' || (event_id % 40)
                         WHEN 'purchase' THEN '/wh/db' || (event_id % 30) || '.db/t4/g' || (event_id % 40)
                         WHEN 'signup' THEN '/tmp/out' || user_id END AS dst,
               CAST(floor(value * 10) AS BIGINT) AS size
        FROM {events}""",
    "stream_jobs": """
        SELECT CAST(n_nationkey AS BIGINT) AS job_id, 'hdfs://nn:9000/wh/db' || n_nationkey || '.db/' AS source_path,
               'hdfs://dr:9000/mirror/db' || n_nationkey || '.db' AS target_path, n_regionkey <> 0 AS sync_deletes,
               n_regionkey IN (1, 2) AS companion, n_regionkey = 1 AS delete_table_dirs, n_regionkey <> 3 AS delete_inside_tables
        FROM {nation}""",
    "catalog_events": """
        SELECT conv_id * 100 + turn AS event_id, 't' || conv_id AS table_name,
               CASE WHEN role = 'system' THEN 'CREATE_TABLE' WHEN turn = 3 THEN 'DROP_TABLE'
                    WHEN turn = 5 THEN 'ALTER_TABLE' WHEN turn = 2 THEN 'INSERT' WHEN turn = 6 THEN 'COMMIT_TXN'
                    ELSE 'alter_table' END AS event_type,
               CASE WHEN turn = 5 THEN 't' || conv_id || '_r' END AS renamed_to,
               length(text) AS payload
        FROM {conversations}""",
    "partition_events": """
        SELECT event_id, 't' || (user_id % 60) || CASE WHEN value > 40 THEN '_r' ELSE '' END AS table_name,
               CASE WHEN event_type = 'signup' AND value < 30 THEN NULL ELSE 'dt=' || (event_id % 9) END AS part_name,
               CASE event_type WHEN 'view' THEN 'ADD_PARTITION' WHEN 'click' THEN 'ALTER_PARTITION' WHEN 'error' THEN 'drop_partition'
                    WHEN 'signup' THEN CASE WHEN value < 1 THEN 'DROP_TABLE' WHEN value < 3 OR value > 99 THEN 'ALTER_TABLE' WHEN value < 30 THEN 'CREATE_TABLE' ELSE 'INSERT' END
                    ELSE 'INSERT' END AS event_type,
               CASE WHEN event_type = 'signup' AND value >= 1 AND value < 3 THEN 't' || (user_id % 60) || '_r'
                    WHEN event_type = 'signup' AND value > 99 THEN 'arch_' || (user_id % 60) END AS renamed_to,
               CAST(length(props) AS BIGINT) AS payload
        FROM {events}""",
    "statements": """
        SELECT event_id AS id, 'u' || user_id AS username,
               CASE event_type WHEN 'view' THEN 'SELECT * FROM lake.t' || user_id
                    WHEN 'click' THEN 'select a, b from lake.t' || user_id || ' x join lake.u' || user_id || ' y on x.id = y.id where a > 1'
                    WHEN 'error' THEN 'SELECT * from t' || user_id || ' JOIN u' || user_id
                    WHEN 'signup' THEN 'SHOW TABLES' ELSE 'Select region, count(*) FROM s.t' || user_id || ' GROUP BY region ORDER BY 2 LIMIT 10' END AS sql_text,
               CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS created_s,
               CASE WHEN value < 60 THEN 'FINISHED' WHEN value < 90 THEN 'FAILED' ELSE 'KILLED' END AS status,
               CASE event_type WHEN 'view' THEN 'trino' WHEN 'click' THEN 'HIVE' WHEN 'error' THEN NULL ELSE ' ' || event_type END AS engine,
               CAST(floor(value * 1000) AS BIGINT) AS duration_ms,
               CASE WHEN value > 60 THEN true ELSE false END AS shared
        FROM {events}""",
    "groups": """
        SELECT CASE WHEN user_id % 7 = 0 THEN 'connect-' || user_id WHEN user_id % 11 = 0 THEN ' __consumer' || user_id
                    WHEN user_id % 13 = 0 THEN ' ' ELSE 'app-' || user_id END AS group_id,
               'topic-' || event_type AS topic, CAST(user_id % 8 AS INT) AS part, max(event_id) AS committed
        FROM {events} GROUP BY user_id, event_type""",
}


def _write_files(batches):
    import pyarrow as pa

    from strandline.sources.stores import open_store

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            system, where = open_store(path)
            system.create_dir(where.rsplit("/", 1)[0])
            with system.open_output_stream(where, compression=None) as out:
                out.write(content)
        yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])


def written_files(contents: DataFrame) -> int:
    """Write (path, content) rows as files of their own; how many there were."""
    return contents.select("path", "content").mapInArrow(_write_files, "path string").count()


def spark_text(name: str) -> str:
    return re.sub(
        r"epoch_us\(",
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ",
        FIXTURES[name],
    )


class Tables:
    """Given and derived tables of one data folder, by attribute or by call."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(self.path(name))
        if name in FIXTURES:
            return self(name)
        raise AttributeError(name)

    def stream(self, name: str) -> DataFrame:
        """The same table as a stream of its files, be it one file or a folder of them."""
        if name in GIVEN:
            # the stream source takes a single file only by a pattern
            return self.spark.readStream.schema(self(name).schema).parquet(f"{self.path(name)[:-1]}[t]")
        inner = set(re.findall(r"\{(\w+)\}", FIXTURES[name]))
        return self.spark.sql(spark_text(name), **{table: self.stream(table) for table in inner})

    def stream_in_parts(self, name: str, by: str, parts: int, path: str | None = None, only: range | None = None) -> DataFrame:
        """The same table as a stream of micro-batches: written in ``parts`` ranges of a whole-number column, read in that order.

        ``only`` writes some of the ranges to ``path``; a later call adds others. So the ranges must be the same in every
        call: they divide the span of the column evenly, approximate quantiles may differ from run to run. Rows
        without a value are in the first range. A part is one file, of row groups that several tasks read.
        """
        df, path = self(name), path or scratch_path(self.spark, name)
        least, most = df.agg(F.min(by), F.max(by)).first()
        cuts = [] if least is None else [least + (most - least) * k // parts for k in range(1, parts)]
        for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
            if only is not None and k not in only:
                continue
            part = df if low is None else df.where(F.col(by) > low)
            if high is not None:
                part = part.where((F.col(by) <= high) | F.col(by).isNull() if low is None else F.col(by) <= high)
            part.repartition(1).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/{k:03d}")
        reader = self.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        return reader.parquet(path)

    def __call__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(self.path(name))
        inner = set(re.findall(r"\{(\w+)\}", FIXTURES[name]))
        return self.spark.sql(spark_text(name), **{table: self(table) for table in inner})

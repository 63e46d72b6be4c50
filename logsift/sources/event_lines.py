"""Log text derived from the driver's ``events`` table (the ``raw_lines``
fixture).  One SELECT, written once with dialect placeholders, so that the
Spark source and the DuckDB oracle produce identical text.

Branches by ``event_id % 8``: 0 syslog, 1 access log, 2 firewall, 3 network
device, 4 Windows event, 5 JSON, 6 container, 7 blank / priority / free text
with a MAC address.  Every event gives one line; the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW_LINES_SQL = """SELECT event_id, ts, 'host-' || cast(user_id % 20 AS varchar(20)) AS source, CASE event_id % 8
 WHEN 0 THEN {syslog} || ' host-' || cast(user_id % 20 AS varchar(20)) || ' ' || event_type || '[' || cast(user_id AS varchar(20)) || ']: ' || event_type || ' from ' || {ip} || ' port: ' || cast(1024 + event_id % 60000 AS varchar(20))
 WHEN 1 THEN {ip} || ' - - [' || {apache} || '] "GET /' || event_type || '/' || cast(event_id AS varchar(20)) || ' HTTP/1.1" ' || (CASE WHEN event_type = 'error' THEN '500' ELSE '200' END) || ' ' || cast(event_id % 5000 AS varchar(20))
 WHEN 2 THEN 'fw ' || (CASE user_id % 4 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'DENY' WHEN 2 THEN 'DROP' ELSE 'REJECT' END) || ' IN=eth0 SRC=' || {ip} || ' DST=192.168.1.' || cast(event_id % 250 AS varchar(20)) || ' PROTO=TCP SPT=' || cast(1024 + event_id % 60000 AS varchar(20)) || ' DPT=443'
 WHEN 3 THEN {syslog} || '.123: %LINK-' || cast(event_id % 7 AS varchar(20)) || '-UPDOWN: Interface ' || event_type || ' changed state'
 WHEN 4 THEN {dt} || ' ' || (CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END) || ' ' || cast(4000 + event_id % 50 AS varchar(20)) || ' svc-' || event_type || ' ' || event_type || ' took ' || cast(event_id AS varchar(20)) || ' ms'
 WHEN 5 THEN '{{"timestamp":"' || {iso} || 'Z","level":"' || (CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END) || '","message":"' || event_type || ' by user ' || cast(user_id AS varchar(20)) || '","src_ip":"' || {ip} || '","k":' || cast(user_id AS varchar(20)) || '}}'
 WHEN 6 THEN {iso} || '.123456Z ' || (CASE WHEN event_type = 'error' THEN 'WARN' ELSE 'INFO' END) || ' c' || cast(user_id AS varchar(20)) || ' tcp connection failed for ' || event_type
 ELSE (CASE event_id % 3 WHEN 0 THEN '   ' WHEN 1 THEN '<' || cast(event_id % 192 AS varchar(20)) || '>free text ' || event_type ELSE 'connection blocked ' || event_type || ' aa:bb:cc:dd:ee:0' || cast(event_id % 10 AS varchar(20)) END)
 END AS line FROM {tbl}"""

_IP = ("'10.0.' || cast(user_id % 7 AS varchar(20)) || '.' || "
       "cast(user_id % 250 AS varchar(20))")

SPARK_PLACEHOLDERS = {
    "syslog": "date_format(ts,'MMM dd HH:mm:ss')",
    "apache": "date_format(ts,'dd/MMM/yyyy:HH:mm:ss') || ' +0000'",
    "dt": "date_format(ts,'yyyy-MM-dd HH:mm:ss')",
    "iso": "date_format(ts,\"yyyy-MM-dd'T'HH:mm:ss\")",
    "ip": _IP,
}
DUCKDB_PLACEHOLDERS = {
    "syslog": "strftime(ts,'%b %d %H:%M:%S')",
    "apache": "strftime(ts,'%d/%b/%Y:%H:%M:%S') || ' +0000'",
    "dt": "strftime(ts,'%Y-%m-%d %H:%M:%S')",
    "iso": "strftime(ts,'%Y-%m-%dT%H:%M:%S')",
    "ip": _IP,
}

N_FILES = 11  # file identity of a line: 'file-' || event_id % 11 || '.log'


def raw_lines_sql(dialect: str, table: str = "events") -> str:
    ph = SPARK_PLACEHOLDERS if dialect == "spark" else DUCKDB_PLACEHOLDERS
    return RAW_LINES_SQL.format(tbl=table, **ph)


ROWS_PER_TASK = 50_000


def spread(df: DataFrame, *order_by: str) -> DataFrame:
    """Spread rows over the cores before CPU-heavy work, about ``ROWS_PER_TASK``
    to a task at most.  A split of a file holds whole row groups, so neither the
    number of splits nor their bytes bound the rows of a task: one row group may
    hold a whole table.  With ``order_by`` the rows are split into contiguous
    ranges of those columns (sampled bounds, so balanced whatever the
    distribution): rows close in time stay together and a date-partitioned write
    makes few files.  Without it, round-robin."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))
    return df.repartitionByRange(n, *order_by) if order_by else df.repartition(n)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table in ranges of time, spread before its lines are made."""
    return spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "event_id")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns: event_id, ts, source, line, filename, file_id, ingest_seq, ingest_ts.

    ``ingest_ts`` (the time of lines that carry none) is the event time, and
    ``ingest_seq`` (arrival order) is the event id.
    """
    view = f"_events_{abs(hash(sf_dir))}"
    events(spark, sf_dir).createOrReplaceTempView(view)
    df = spark.sql(raw_lines_sql("spark", view))
    filename = F.concat(F.lit("file-"), (F.col("event_id") % N_FILES).cast("string"), F.lit(".log"))
    return df.select(
        "event_id", "ts", "source", "line",
        filename.alias("filename"),
        F.substring(F.md5(filename), 1, 16).alias("file_id"),
        F.col("event_id").alias("ingest_seq"),
        F.col("ts").alias("ingest_ts"))


BLOCK = 1 << 16         # event ids in a block of a fixture file


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw lines grouped into the fixture's files ('file-<n>.log'), in the
    layout of ``text_files.read_lines``: blocks of event ids, within a block the
    lines numbered by event id; modification time = the latest event time of the
    file."""
    lines = raw_lines(spark, sf_dir).withColumn("block_start", F.floor(F.col("event_id") / BLOCK))
    times = lines.groupBy("file_id").agg(F.max(F.col("ts").cast("timestamp")).alias("file_mtime"))
    pos = F.row_number().over(Window.partitionBy("file_id", "block_start").orderBy("event_id"))
    return (lines.withColumn("pos", pos).join(times, "file_id")
            .select("line", "file_id", F.col("filename").alias("original_filename"), "file_mtime", "block_start",
                    F.col("pos").cast("bigint").alias("pos")))

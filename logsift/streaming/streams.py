"""Structured Streaming jobs.

Inputs are file streams (new files in a folder) and the tail of growing files; every query has a
checkpoint location, so a restarted job resumes from its last committed
batch and output written through ``foreachBatch`` is idempotent per batch id.

* R1 collector ingestion: JSON records -> one parse path -> logs table.
* R2 file tail: new log files, or lines added to growing ones -> parse -> logs table.
* R3 live feed: dedupe by log id within a 5-minute watermark; each batch
  merges into the newest 20 rows (U2, J5).
* R4 periodic detection: a timer stream whose batches run the detectors on
  the stored logs table.
* R5/R6 hourly counts per level: tumbling one-hour windows, 1-hour watermark.
* R7 running template statistics (S15): state per id, or deltas of a merge table;
  mined templates (T1) the same way.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import parse_lines
from ..operators.templates import assign_exact_templates
from ..schema import COLLECTOR_SCHEMA
from ..sources.fs import names
from ..sources.sinks import append_logs
from ..sources.structured import collector_to_entries, entries_to_logs
from ..sources.text_files import tail_lines


def _with_id(logs: DataFrame) -> DataFrame:
    """``log_id`` from what the record holds, so that a record read again has
    the same id (as have records alike in time, source, text and metadata)."""
    key = F.struct("timestamp", "source", "message", F.sort_array(F.map_entries("metadata")).alias("metadata"))
    return logs.withColumn("log_id", F.md5(F.to_json(key)))


def collector_stream(spark: SparkSession, input_dir: str) -> DataFrame:
    """Collector JSON-lines files -> log rows (streaming DataFrame)."""
    recs = spark.readStream.schema(COLLECTOR_SCHEMA).json(input_dir)
    return _with_id(entries_to_logs(collector_to_entries(recs)))


def file_tail_stream(spark: SparkSession, directory: str, tag_prefix: str = "file",
                     host: str | None = None) -> DataFrame:
    """New files of a folder -> log rows; source = host, else tag."""
    lines = tail_lines(spark, directory, tag_prefix, host)
    raw = lines.select(F.col("log").alias("line"),
                       F.coalesce("source", "tag").alias("source"),
                       F.col("file_mtime").alias("ingest_ts"),
                       F.col("file").alias("filename"),
                       F.unix_micros("file_mtime").alias("ingest_seq"))
    logs = assign_exact_templates(parse_lines(raw))
    return _with_id(logs).withColumn("event_date", F.to_date("timestamp"))


def growing_file_stream(spark: SparkSession, path: str, tag: str = "file.*", host: str | None = None,
                        **options) -> DataFrame:
    """Lines added to growing files (``sources.tail``) -> log rows;
    source = host, else tag.  A row's id is its file and byte position, its
    ``ingest_seq`` the position in its file."""
    from ..sources.tail import tail
    lines = tail(spark, path, tag, **options)
    file_id = F.md5(F.concat_ws("|", "file", "inode"))
    raw = lines.select(F.col("log").alias("line"), F.coalesce(F.lit(host).cast("string"), "tag").alias("source"),
                       F.col("file_mtime").alias("ingest_ts"), F.col("file").alias("filename"),
                       file_id.alias("file_id"), F.col("offset").alias("ingest_seq"))
    logs = assign_exact_templates(parse_lines(raw))
    return logs.withColumns({"log_id": F.concat_ws("-", "file_id", F.col("ingest_seq").cast("string")),
                             "event_date": F.to_date("timestamp")})


def start_logs_sink(logs_stream: DataFrame, table_path: str, checkpoint: str,
                    trigger: dict | None = None):
    """Add every micro-batch to the partitioned logs table.  A batch owns
    the folder ``ingest_batch=<stream>-<batch id>``, so a batch that is done
    again replaces its rows instead of doubling them."""
    trigger = trigger or {"processingTime": "1 second"}
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def write(batch: DataFrame, batch_id: int) -> None:
        if "log_id" not in batch.columns:
            batch = batch.withColumn("log_id", F.concat_ws(
                "-", F.lit(stream), F.lit(str(batch_id)), F.monotonically_increasing_id().cast("string")))
        append_logs(batch, f"{table_path}/ingest_batch={stream}-{batch_id}", mode="overwrite")

    return (logs_stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def live_feed(logs_stream: DataFrame, feed_path: str, checkpoint: str, keep: int = 20,
              trigger: dict | None = None):
    """Rows deduplicated by log id within a 5-minute watermark; each
    batch is merged with the rows already shown and the newest ``keep`` are
    written as the feed of that batch (``<feed_path>/batch=<id>``)."""
    trigger = trigger or {"processingTime": "5 seconds"}
    deduped = (logs_stream.withWatermark("timestamp", "5 minutes")
               .dropDuplicatesWithinWatermark(["log_id"]))

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # the feed of the batch before; only a folder that isn't there counts as none
        before = f"{feed_path}/batch={batch_id - 1}"
        prev = spark.read.parquet(before) if names(spark, before) else None
        cols = ["log_id", "timestamp", "level", "message", "source"]
        cur = batch.select(*cols)
        if prev is not None:
            cur = cur.unionByName(prev.select(*cols)).dropDuplicates(["log_id"])
        (cur.orderBy(F.col("timestamp").desc(), F.col("log_id")).limit(keep)
         .write.mode("overwrite").parquet(f"{feed_path}/batch={batch_id}"))

    return (deduped.writeStream.foreachBatch(merge)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def hourly_level_counts(logs_stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Rows per one-hour window and level.  Rows later than the
    watermark are dropped from the state (the batch tables recompute them)."""
    return (logs_stream.withWatermark("timestamp", watermark)
            .groupBy(F.window("timestamp", "1 hour").alias("w"), "level")
            .agg(F.count(F.lit(1)).alias("count"))
            .select(F.col("w.start").alias("hour"), "level", "count"))


def running_template_stats(logs_stream: DataFrame) -> DataFrame:
    """Per template id, rows, first and last event time (state per id)."""
    return (logs_stream.groupBy("template_id")
            .agg(F.count(F.lit(1)).alias("count"), F.min("timestamp").alias("first_seen"),
                 F.max("timestamp").alias("last_seen")))


def start_table_sink(agg_stream: DataFrame, out_path: str, checkpoint: str,
                     output_mode: str = "complete", trigger: dict | None = None):
    """Write an aggregate stream's current result as a parquet table per batch
    (complete mode: the whole result; update mode: the changed rows, in a folder
    ``_batch=<id>`` that a batch done again replaces)."""
    trigger = trigger or {"processingTime": "1 second"}

    def write(batch: DataFrame, batch_id: int) -> None:
        if output_mode == "complete":
            batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(out_path)
        else:
            batch.write.mode("overwrite").parquet(f"{out_path}/_batch={batch_id}")

    return (agg_stream.writeStream.outputMode(output_mode).foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def start_merge_sink(logs_stream: DataFrame, table_path: str, checkpoint: str, trigger: dict | None = None):
    """Template statistics as a merge table.  A batch adds its own
    statistics as a delta; nothing is rewritten, readers always see a whole
    snapshot, and a batch done again changes nothing."""
    from ..operators.merge_table import MergeTable, merge_stats
    from ..operators.templates import template_stats
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def write(batch: DataFrame, batch_id: int) -> None:
        stats = template_stats(batch).drop("cluster_size")
        MergeTable(batch.sparkSession, table_path, merge_stats).add(stats, stream, batch_id)

    return (logs_stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 seconds"})).start())


def start_template_miner(logs_stream: DataFrame, store_path: str, checkpoint: str, trigger: dict | None = None):
    """T1/T3/T5 incrementally: every batch is matched with the store's templates
    and its new messages are mined into it (``operators.merge_table``)."""
    from ..operators.merge_table import TemplateStore
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def write(batch: DataFrame, batch_id: int) -> None:
        TemplateStore(batch.sparkSession, store_path).add(batch, stream, batch_id)

    return (logs_stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 seconds"})).start())


def periodic_detection(spark: SparkSession, logs_path: str, anomalies_path: str,
                       checkpoint: str, interval: str = "300 seconds", hours: int = 24,
                       retry_after: float = 60.0):
    """Every ``interval`` run all detectors over the stored logs table with
    as_of = the batch's time.  Each detector's anomalies are written on their own
    (``run=<batch id>/detector=<name>``, replaced when the batch is done again),
    so one that fails leaves the others whole; failed ones are tried once more
    after ``retry_after`` seconds."""
    from ..operators.anomalies import run_detection
    from ..operators.templates import template_stats
    from ..sources.sinks import write_anomalies

    timer = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def run(batch: DataFrame, batch_id: int) -> None:
        as_of = batch.agg(F.max("timestamp")).first()[0]
        if as_of is None:
            return
        logs = spark.read.parquet(logs_path)
        templates = template_stats(logs)

        def sink(name: str, df: DataFrame) -> None:
            write_anomalies(df, f"{anomalies_path}/run={batch_id}/detector={name}")

        failed = run_detection(logs, templates, as_of, hours, sink=sink).failed
        if failed:
            time.sleep(retry_after)
            run_detection(logs, templates, as_of, hours, sink=sink, only=failed)

    return (timer.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(processingTime=interval).start())

"""Sinks (S13, S14, S17, S19, S21): parquet tables and JSON/CSV exports.

Batch writes are whole-job commits (a lost executor re-runs its tasks, the
output committer keeps only finished task files); streaming writes go
through a checkpoint location so a restarted query resumes exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append_logs(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Append log rows to the table, partitioned by event date."""
    (logs.sortWithinPartitions("event_date", "timestamp")
     .write.mode(mode).partitionBy("event_date").parquet(path))


def append_anomalies(anomalies: DataFrame, path: str) -> None:
    """Append anomaly rows with their creation time."""
    (anomalies.withColumn("created_at", F.current_timestamp())
     .write.mode("append").parquet(path))


def write_anomalies(anomalies: DataFrame, path: str) -> None:
    """One detector's rows of one run; a second try replaces the first."""
    anomalies.withColumn("created_at", F.current_timestamp()).write.mode("overwrite").parquet(path)


def _text_safe(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text (CSV has no nested types)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def export(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Export a query result as JSON lines or CSV with a header."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "csv":
        _text_safe(df).write.mode("overwrite").option("header", "true").csv(path)
    else:
        raise ValueError(f"unknown export format {fmt}")


def anomaly_report(anomalies: DataFrame) -> DataFrame:
    """Report rows: ISO time, type, severity, description, score, details."""
    return anomalies.select(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.col("anomaly_type").alias("type"), "severity", "description", "score", "details")


def write_json_lines(df: DataFrame, path: str) -> None:
    """S13 (batch): JSON lines output."""
    df.write.mode("append").json(path)


def stream_json_lines(sdf: DataFrame, path: str, checkpoint: str, trigger: str = "1 second"):
    """S13/R1 (stream): JSON lines output with a 1-second trigger."""
    return (sdf.writeStream.format("json").option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(processingTime=trigger).outputMode("append").start())


def stream_console(sdf: DataFrame, checkpoint: str, trigger: str = "1 second"):
    """S13 (stream): console output of each micro-batch (debugging)."""
    return (sdf.writeStream.format("console").option("truncate", "false")
            .option("checkpointLocation", checkpoint).trigger(processingTime=trigger)
            .outputMode("append").start())

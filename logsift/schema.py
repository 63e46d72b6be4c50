"""Table schemas of the stored data model (logs, templates, files, anomalies)."""

from __future__ import annotations

from pyspark.sql import types as T

NETWORK_INFO_TYPE = T.StructType([
    T.StructField("ip_addresses", T.ArrayType(T.StringType())),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("src_port", T.StringType()),
    T.StructField("dst_port", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("ports", T.ArrayType(T.StringType())),
    T.StructField("protocols", T.ArrayType(T.StringType())),
    T.StructField("mac_addresses", T.ArrayType(T.StringType())),
])

MAP_SS = T.MapType(T.StringType(), T.StringType())

LOGS_COLUMNS = ("log_id", "timestamp", "level", "message", "source", "log_type", "network_info",
                "parsed_fields", "metadata", "template_id", "template", "file_id", "filename",
                "ingest_seq", "created_at", "event_date")

ANOMALY_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("anomaly_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("affected_templates", T.ArrayType(T.StringType())),
    T.StructField("log_count", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("details", MAP_SS),
])
ANOMALY_COLUMNS = tuple(f.name for f in ANOMALY_SCHEMA.fields)

TEMPLATE_COLUMNS = ("template_id", "template", "count", "first_seen", "last_seen", "cluster_size")

FILE_COLUMNS = ("file_id", "filename", "original_filename", "file_size", "upload_timestamp",
                "completed_at", "processed_logs", "failed_logs", "status", "error")

ENTRY_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("metadata", MAP_SS),
])

COLLECTOR_SCHEMA = T.StructType([
    T.StructField("log", T.StringType()),
    T.StructField("time", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("source", T.StringType()),
])

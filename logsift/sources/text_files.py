"""Text log files (S1-S4, S7-S9, P11, P20): lines, file registry, counts.

Files are read with Spark's text source (``lineSep='\\n'`` keeps a trailing
``\\r`` like a plain split on newline).  A file is split into blocks like any
input, so no file passes whole through one task.

Line numbers do not depend on the blocks.  A task numbers the rows it scans one
after the other, so the lines of a block have consecutive numbers; a first pass
aggregates lines, bytes and first numbers by (file, block), a running sum over a
file's blocks gives the lines before each block, and a line's number is that sum
plus its place in the block.  The same aggregates, all longs, give the registry
without a join to the lines; empty files come from a listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from . import fs

_EXT_RE = "(" + "|".join(e.replace(".", r"\.") for e in K.ACCEPTED_EXTENSIONS) + ")$"


def _accepted(name: F.Column) -> F.Column:
    """Only .log .txt .json files."""
    return name.rlike(_EXT_RE)


def file_identity(path: F.Column, mtime: F.Column) -> F.Column:
    """A stable file id: the same file gives the same id on every run."""
    return F.substring(F.sha2(F.concat_ws("|", path, mtime.cast("string")), 256), 1, 32)


_FILE = ("file_id", "original_filename", "file_size", "file_mtime")


def read_lines(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """One row per line with its file's identity and its place: line,
    file_path, original_filename, file_size, file_mtime, block_start, file_id, pos
    (consecutive in a block)."""
    reader = spark.read.option("lineSep", "\n")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    m = F.col("_metadata")
    df = reader.text(path).select(
        F.col("value").alias("line"),
        m["file_path"].alias("file_path"), m["file_name"].alias("original_filename"),
        m["file_size"].alias("file_size"), m["file_modification_time"].alias("file_mtime"),
        m["file_block_start"].alias("block_start"))
    df = df.where(_accepted(F.col("original_filename")))
    return (df.withColumn("pos", F.monotonically_increasing_id())
            .withColumn("file_id", file_identity(F.col("file_path"), F.col("file_mtime"))))


def empty_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """The files of a folder that hold no byte (Spark's readers pass over them),
    from one listing of names and sizes: file_id, original_filename, file_size,
    file_mtime."""
    found, base = [], fs.fs_path(spark, path)
    files = base[0].listFiles(base[1], recursive)
    while files.hasNext():
        f = files.next()
        if f.getLen() == 0:
            found.append((f.getPath().toString(), f.getPath().getName(), f.getModificationTime()))
    df = spark.createDataFrame(found, "file_path string, original_filename string, ms long")
    df = df.where(_accepted(F.col("original_filename"))).withColumn("file_mtime", F.timestamp_millis("ms"))
    return df.select(file_identity(F.col("file_path"), F.col("file_mtime")).alias("file_id"), "original_filename",
                     F.lit(0).cast("bigint").alias("file_size"), "file_mtime")


def block_stats(lines: DataFrame) -> DataFrame:
    """Per (file, block): lines, bytes, first number, first and last number of a
    line that isn't blank (P11), their count, whether all is UTF-8, and ``before``,
    the lines of the file's earlier blocks."""
    blank = F.regexp_replace(F.col("line"), r"^\s+|\s+$", "") == ""
    own = [c for c in _FILE if c in lines.columns]
    thin = lines.select(*own, "block_start", "pos", (~blank).alias("full"), F.octet_length("line").alias("size"),
                        F.is_valid_utf8("line").alias("utf8"))
    stats = thin.groupBy(*own, "block_start").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min("pos").alias("lo"),
        F.min(F.when(F.col("full"), F.col("pos"))).alias("first"), F.max(F.when(F.col("full"), F.col("pos"))).alias("last"),
        F.count_if("full").alias("full"), F.bool_and("utf8").alias("utf8"))
    # one row per block of 100 MB or so
    earlier = Window.partitionBy("file_id").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    return stats.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def number_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with ``ingest_seq``, the number of the line in its file from 0,
    the same however the file is split."""
    blocks = block_stats(lines).select("file_id", "block_start", "lo", "before")
    return (lines.join(blocks, ["file_id", "block_start"])
            .withColumn("ingest_seq", F.col("before") + F.col("pos") - F.col("lo")).drop("lo", "before", "pos"))


def file_registry(lines: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """One row per file: id, names, size, times, processed lines,
    failed lines (blank ones between the first and the last that isn't; 1 for a
    file without any other), status ('failed' when any line is not valid UTF-8;
    such a file stores no rows, as an undecodable upload is rejected whole).
    ``empty`` adds files without lines."""
    blocks = block_stats(lines)
    own = [c for c in _FILE if c in blocks.columns]
    first, last = (F.col("before") + F.col(c) - F.col("lo") for c in ("first", "last"))
    files = blocks.groupBy(*own).agg(
        F.sum("full").alias("full"), F.min(first).alias("first"), F.max(last).alias("last"),
        F.bool_and("utf8").alias("utf8"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    if empty is not None:
        files = files.unionByName(empty, allowMissingColumns=True)
    # a file's text is its lines joined by newlines when no size is given
    size = F.col("file_size") if "file_size" in own else F.col("size") + F.col("n") - 1
    ok, full = F.coalesce("utf8", F.lit(True)), F.coalesce("full", F.lit(0))
    return files.select(
        "file_id",
        F.concat_ws("_", "file_id", "original_filename").alias("filename"),
        "original_filename", size.cast("bigint").alias("file_size"), F.col("file_mtime").alias("upload_timestamp"),
        F.col("file_mtime").alias("completed_at"),
        F.when(ok, full).otherwise(F.lit(0)).alias("processed_logs"),
        F.when(~ok, F.lit(0)).when(full == 0, F.lit(1))
        .otherwise(F.col("last") - F.col("first") + 1 - F.col("full")).alias("failed_logs"),
        F.when(ok, F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
        F.when(ok, F.lit(None)).otherwise(F.lit("File encoding not supported")).alias("error"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry of a folder, empty files included."""
    return file_registry(read_lines(spark, path), empty_files(spark, path))


def ingest_files(spark: SparkSession, path: str):
    """S1-S4 + parse + exact templates: (logs, files).  The source of a row is
    the uploaded file's name, its default time the file's modification time."""
    from ..operators.parse import parse_lines
    from ..operators.templates import assign_exact_templates

    lines = read_lines(spark, path)
    files = file_registry(lines, empty_files(spark, path))
    lines = number_lines(lines)
    good = files.where(F.col("status") == "completed").select("file_id")
    raw = lines.join(good, "file_id", "left_semi").select(
        "line", F.col("original_filename").alias("source"), F.col("file_mtime").alias("ingest_ts"),
        "file_id", F.col("original_filename").alias("filename"), "ingest_seq")
    logs = assign_exact_templates(parse_lines(raw))
    logs = logs.select(
        F.concat(F.col("file_id"), F.lit("-"), F.col("ingest_seq").cast("string")).alias("log_id"),
        "ingest_seq", "timestamp", "level", "message", "source", "log_type", "network_info",
        "parsed_fields", "metadata", "template_id", "template", "file_id", "filename",
        F.col("ingest_ts").alias("created_at"), F.to_date("timestamp").alias("event_date"))
    return logs, files


def list_files(files: DataFrame) -> DataFrame:
    """Newest upload first; missing counts 0, missing status 'unknown'."""
    return (files.select("file_id", "filename", "original_filename", "file_size",
                         "upload_timestamp",
                         F.coalesce("processed_logs", F.lit(0)).alias("processed_logs"),
                         F.coalesce("failed_logs", F.lit(0)).alias("failed_logs"),
                         F.coalesce("status", F.lit("unknown")).alias("status"))
            .orderBy(F.col("upload_timestamp").desc(), F.col("file_id")))


def tail_lines(spark: SparkSession, directory: str, tag_prefix: str = "file",
               host: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """S7/S8/S9 streaming: new files of a directory as lines, with the path
    kept as column ``file``, a tag ``<prefix>.<file name>`` and the host as
    ``source``.  For files dropped whole into a folder, also of a store; lines
    added to a file later are the business of ``sources.tail``."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = reader.text(directory)
    m = F.col("_metadata")
    return df.select(
        F.col("value").alias("log"), m["file_path"].alias("file"),
        F.concat(F.lit(tag_prefix + "."), m["file_name"]).alias("tag"),
        F.lit(host).cast("string").alias("source"),
        m["file_modification_time"].alias("file_mtime"))

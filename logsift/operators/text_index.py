"""Text search over a stored logs table with a trigram index.

The index is a table of postings (gram, file): the distinct three-character runs
of the lower-cased texts of each data file, range-partitioned and sorted by gram,
so that a lookup reads a few row groups.  A search takes the literals that every
match of its regular expression must hold, keeps the files that hold all of their
trigrams, reads only those, and applies the expression itself: the rows equal
those of a scan.  An expression without a literal of three characters, or of a
syntax that is not understood here, reads every file; so do files that were
added after the index was built, until ``TextIndex.refresh``.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fs

GRAM = 3
_SAFE = re.compile(r"[ -~]+")       # other characters have no one lower case


def literals(pattern: str) -> list[str] | None:
    """Lower-case texts that every match of ``pattern`` (case ignored) contains;
    None if the expression is not understood."""
    try:
        parsed = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    if parsed.state.flags & (re.VERBOSE | re.MULTILINE | re.DOTALL):
        return None
    found, run = [], []

    def close():
        found.append("".join(run))
        run.clear()

    def walk(items):
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                run.append(chr(value))
            elif name == "SUBPATTERN" and not value[1] and not value[2]:
                walk(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                close()
                walk(value[2])      # once at least, whatever stands around it
                close()
            else:
                close()

    walk(parsed)
    close()
    return [part for text in found for part in _SAFE.findall(text.lower())]


def grams_of(texts: list[str]) -> set[str]:
    return {t[i:i + GRAM] for t in texts for i in range(len(t) - GRAM + 1)}


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


class TextIndex:
    """Postings of ``columns`` of the parquet table at ``table``, kept at ``path``."""

    def __init__(self, spark: SparkSession, table: str, path: str, columns: tuple[str, ...] = ("message",)):
        self.spark, self.table, self.path, self.columns = spark, table.rstrip("/"), path.rstrip("/"), columns

    def _data(self, files: list[str] | None = None) -> DataFrame:
        reader = self.spark.read.option("basePath", self.table)
        return reader.parquet(*files) if files else reader.parquet(self.table)

    def files(self) -> list[str]:
        return sorted(self._data().inputFiles())

    def _parts(self, kind: str) -> list[str]:
        return [f"{self.path}/{n}" for n in fs.names(self.spark, self.path) if n.startswith(f"{kind}-")]

    def indexed(self) -> set[str]:
        parts = self._parts("files")
        return {r["file"] for r in self.spark.read.parquet(*parts).collect()} if parts else set()

    def refresh(self) -> int:
        """Index the files that are new since the last time; their number."""
        new = sorted(set(self.files()) - self.indexed())
        if not new:
            return 0
        name = uuid.uuid4().hex
        text = F.explode(F.array(*self.columns))
        rows = self._data(new).select(F.input_file_name().alias("file"), text.alias("text"))
        # one row per file and gram leaves a task, however often the gram occurs
        postings = rows.select("file", F.explode(grams(F.col("text"))).alias("gram")).distinct()
        (postings.repartitionByRange("gram").sortWithinPartitions("gram", "file")
         .write.parquet(f"{self.path}/postings-{name}"))
        # written last: files whose postings are not whole are not indexed
        self.spark.createDataFrame([(f,) for f in new], "file string").write.parquet(f"{self.path}/files-{name}")
        return len(new)

    def candidates(self, pattern: str) -> list[str]:
        """The files that may hold a match."""
        words = literals(pattern)
        wanted = grams_of(words) if words else set()
        if not wanted:
            return self.files()
        names = {p.rsplit("-", 1)[1] for p in self._parts("files")}
        parts = [p for p in self._parts("postings") if p.rsplit("-", 1)[1] in names]
        found = set()
        if parts:
            hits = (self.spark.read.parquet(*parts).where(F.col("gram").isin(*sorted(wanted)))
                    .groupBy("file").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)))
            found = {r["file"] for r in hits.collect()}     # names of files
        known = self.indexed()
        return [f for f in self.files() if f in found or f not in known]

    def search(self, pattern: str) -> DataFrame:
        """Rows where a column matches ``pattern``, case ignored."""
        files = self.candidates(pattern)
        data = self._data(files) if files else self._data().where(F.lit(False))
        match = F.lit(False)
        for c in self.columns:
            match = match | F.coalesce(F.col(c).rlike("(?i)" + pattern), F.lit(False))
        return data.where(match)

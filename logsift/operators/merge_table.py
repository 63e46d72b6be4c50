"""Keyed tables that grow by batches (S15, R7): deltas behind a snapshot pointer.

``MergeTable`` holds rows that are merged by key with an associative function
(counts add up, firsts are least, lasts greatest).  A batch is written as a delta
folder of its own; a snapshot file then names the base and the deltas that belong
together.  Readers take the newest whole snapshot and merge its parts, so they
see the table before or after a batch, never between, and nothing a snapshot names
is rewritten.  ``compact`` merges the parts into a new base; ``vacuum`` removes
what the last snapshots no longer name.

A stream names itself and its batch: a batch done again is already in the
snapshot and changes nothing.  Two writers race for the next snapshot number; the
slower one reads the other's snapshot and tries again.

``TemplateStore`` keeps mined templates this way (T3, T5): messages are matched
with those known, and only the tree paths with new messages are mined again
(templates of different paths are independent).  Ids come from a template's
earliest message, so a template that widens keeps its id and ``first_seen``, and
any split of the logs into batches gives what one batch gives.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import short_md5_id
from ..sources import fs
from . import mining

TRIES = 20
COMPACT_AFTER = 16      # deltas a reader merges at most before they are compacted


class Snapshots:
    """Numbered files under ``path``/snapshots, each a JSON object; the newest
    whole one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, f"{path.rstrip('/')}/snapshots"

    def numbers(self) -> list[int]:
        return sorted(int(m[1]) for n in fs.names(self.spark, self.folder) if (m := re.fullmatch(r"(\d+)\.json", n)))

    def load(self, number: int) -> dict | None:
        try:
            return json.loads(fs.read_text(self.spark, f"{self.folder}/{number:012d}.json"))
        except json.JSONDecodeError:    # still being written
            return None

    def newest(self) -> dict:
        for n in reversed(self.numbers()):
            if (found := self.load(n)) is not None:
                return found
        return {"number": 0, "streams": {}}

    def commit(self, after: dict, content: dict) -> bool:
        number = after["number"] + 1
        return fs.create_text(self.spark, f"{self.folder}/{number:012d}.json", json.dumps({**content, "number": number}))


class MergeTable:
    """``merge`` makes one row per key from the union of parts."""

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.merge = spark, path.rstrip("/"), merge
        self.snapshots = Snapshots(spark, path)

    def parts(self, snapshot: dict) -> list[str]:
        return [f"{self.path}/{p}" for p in [snapshot.get("base"), *snapshot.get("deltas", [])] if p]

    def read(self, snapshot: dict | None = None) -> DataFrame | None:
        """The merged rows of a snapshot (the newest one), None before the first."""
        parts = self.parts(snapshot or self.snapshots.newest())
        return self.merge(self.spark.read.parquet(*parts)) if parts else None

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def add(self, rows: DataFrame, stream: str = "", batch: int | None = None) -> bool:
        """Add a batch (one row per key); False if the snapshot has it already."""
        delta = None
        for _ in range(TRIES):
            now = self.snapshots.newest()
            if batch is not None and now["streams"].get(stream, -1) >= batch:
                return False
            delta = delta or self._write(rows, "delta")
            new = {**now, "deltas": [*now.get("deltas", []), delta]}
            if batch is not None:
                new["streams"] = {**now["streams"], stream: batch}
            if self.snapshots.commit(now, new):
                if len(new["deltas"]) >= COMPACT_AFTER:
                    self.compact()
                return True
        raise RuntimeError(f"{self.path}: no snapshot after {TRIES} tries")

    def compact(self) -> None:
        """One base in place of base and deltas; a batch added meanwhile stays a
        delta."""
        now = self.snapshots.newest()
        if not now.get("deltas"):
            return
        base = self._write(self.read(now), "base")
        for _ in range(TRIES):
            later = self.snapshots.newest()
            if later.get("base") != now.get("base"):
                return      # another writer has compacted; this base is vacuumed
            deltas = [d for d in later["deltas"] if d not in now["deltas"]]
            if self.snapshots.commit(later, {**later, "base": base, "deltas": deltas}):
                return

    def vacuum(self, keep: int = 2) -> None:
        """Remove the parts and snapshot files that the last ``keep`` snapshots
        do not name."""
        numbers = self.snapshots.numbers()
        held = [s for n in numbers[-keep:] if (s := self.snapshots.load(n))]
        named = {p for s in held for p in [s.get("base"), *s.get("deltas", [])]}
        for name in fs.names(self.spark, self.path):
            if re.match("(base|delta)-", name) and name not in named:
                fs.delete(self.spark, f"{self.path}/{name}")
        for n in numbers[:-keep]:
            fs.delete(self.spark, f"{self.snapshots.folder}/{n:012d}.json")


def merge_stats(rows: DataFrame) -> DataFrame:
    """Template statistics (template_id, template, count, first_seen, last_seen)
    of several batches as those of one."""
    return rows.groupBy("template_id").agg(
        F.min("template").alias("template"), F.sum("count").alias("count"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def _newest_of_path(rows: DataFrame) -> DataFrame:
    """Of each tree path, the rows of its latest mining."""
    latest = rows.groupBy("path").agg(F.max("version").alias("version"))
    return rows.join(latest, ["path", "version"])


class TemplateStore:
    """Mined templates over batches of logs (template, ingest_seq, timestamp)."""

    def __init__(self, spark: SparkSession, path: str, **rule):
        self.spark, self.rule = spark, rule
        self.messages = MergeTable(spark, f"{path.rstrip('/')}/messages", mining.merge_message_stats)
        self.mined = MergeTable(spark, f"{path.rstrip('/')}/mined", _newest_of_path)

    def _path(self):
        return mining.tree_path(mining.message_tokens(F.col("message")), self.rule.get("depth", mining.K.DRAIN_DEPTH))

    def add(self, logs: DataFrame, stream: str = "", batch: int | None = None) -> None:
        """Match a batch's messages with the known ones and mine the paths of the
        new ones again.  The messages are committed first: a job that dies between
        the two finds them unmined and mines them in the redone batch."""
        self.messages.add(mining.message_stats(logs), stream, batch)
        self.mine()

    def mine(self) -> None:
        """Mine the paths that hold messages without a template."""
        messages = self.messages.read()
        if messages is None:
            return
        known = self.mined.read()
        messages = messages.withColumn("path", self._path())
        fresh = messages if known is None else messages.join(known.select("message"), "message", "left_anti")
        if fresh.isEmpty():
            return
        touched = fresh.select("path").distinct()
        again = messages.join(touched, "path", "left_semi")
        # all messages of a path are mined together, so its rows replace the old
        mined = mining.mine_messages(again, **self.rule).select(
            "path", "message", "mined_template_id", "mined_template",
            F.lit(self.mined.snapshots.newest()["number"] + 1).cast("long").alias("version"))
        self.mined.add(mined)

    def read(self) -> DataFrame | None:
        """One row per message: statistics, mined_template_id, mined_template and
        cluster_size.  A message that a batch has just brought and no mining has
        seen stands for itself under a ``fallback_`` id (T4)."""
        messages, mined = self.messages.read(), self.mined.read()
        if messages is None:
            return None
        none = F.lit(None).cast("string")
        rows = (messages.withColumns({"mined_template_id": none, "mined_template": none}) if mined is None else
                messages.join(mined.select("message", "mined_template_id", "mined_template"), "message", "left"))
        rows = rows.withColumns({
            "mined_template": F.coalesce("mined_template", "message"),
            "mined_template_id": F.coalesce("mined_template_id", short_md5_id("fallback_", F.col("message")))})
        size = rows.groupBy("mined_template_id").agg(F.sum("rows").alias("cluster_size"))
        return rows.join(size, "mined_template_id")

    def templates(self) -> DataFrame | None:
        """Statistics of the mined templates."""
        rows = self.read()
        return None if rows is None else mining.mined_stats(rows)

    def assign(self, logs: DataFrame) -> DataFrame:
        """Log rows with mined id, text and cluster size."""
        return mining.assign_mined_templates(logs, self.read())


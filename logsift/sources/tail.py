"""Tail of growing files (S7, S8, R2) as a streaming Python data source.

``spark.dataSource.register(TailSource)``, then
``spark.readStream.format("log_tail").option("path", "/var/log/*.log").load()``.

A file is known by its identity (device and inode), not by its name, and the
stream's offset holds for each identity the bytes taken so far, up to the last
line break: a half line waits until it is whole.

* *Growth*: the next batch takes the bytes behind the offset.
* *Rotation*: a file renamed to ``<name>.<something>`` keeps its identity, so its
  last lines are still taken; the new file of that name has another identity and
  starts at 0.  Rotated files that were never tailed are not read.
* *Truncation*: a file that is shorter than its offset, or whose first bytes are
  others than before, starts at 0 again.

Bytes are read on executors, in ranges of at most ``split_bytes``; a range owns
the lines that start in it, so batches of any size spread over the cluster and no
line depends on the cuts.  The files have to be mounted on the driver and the
executors alike (a tail follows local files; objects in a store do not grow).

Rows: log (the line), file (path), inode, offset (of the line, in bytes), tag,
file_mtime.  ``tag`` may hold one ``*``, which stands for the path with dots for
slashes; without it the tag is literal.
"""

from __future__ import annotations

import datetime
import glob
import logging
import os
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD = 256              # first bytes that identify a file's content
STEP = 1 << 16
SCHEMA = "log string, file string, inode string, offset long, tag string, file_mtime timestamp"


def identity(path: str) -> tuple[str, os.stat_result]:
    st = os.stat(path)
    return f"{st.st_dev}-{st.st_ino}", st


def whole_lines(path: str, size: int) -> int:
    """The position behind the last line break in the first ``size`` bytes."""
    with open(path, "rb") as f:
        while size > 0:
            lo = max(0, size - STEP)
            f.seek(lo)
            at = f.read(size - lo).rfind(b"\n")
            if at >= 0:
                return lo + at + 1
            size = lo
    return 0


def head_of(path: str, n: int) -> int:
    with open(path, "rb") as f:
        return zlib.crc32(f.read(n))


class Range(InputPartition):
    def __init__(self, path: str, inode: str, first: int, start: int, end: int, last: int):
        self.path, self.inode, self.first, self.start, self.end, self.last = path, inode, first, start, end, last


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.patterns = [p.strip() for p in options["path"].split(",")]
        self.tag = options.get("tag", "file.*")
        self.split = int(options.get("split_bytes", 64 << 20))
        self.from_head = str(options.get("read_from_head", "true")).lower() == "true"

    def _files(self):
        """(path, rotated) of all files that match, and of rotated ones."""
        named = {p for pattern in self.patterns for p in glob.glob(pattern)}
        old = {p for pattern in self.patterns for p in glob.glob(pattern + ".*")} - named
        return [(p, False) for p in sorted(named)] + [(p, True) for p in sorted(old)]

    def _state(self) -> dict:
        out = {}
        for path, rotated in self._files():
            try:
                inode, st = identity(path)
                n = min(HEAD, st.st_size)
                # nothing is added to a rotated file: its last line is whole
                at = st.st_size if rotated else whole_lines(path, st.st_size)
                out[inode] = {"path": os.path.abspath(path), "at": at, "head": head_of(path, n), "n": n,
                              "rotated": rotated}
            except OSError:     # gone since it was listed
                continue
        return out

    def initialOffset(self) -> dict:
        return {"files": {}} if self.from_head else {"files": self._state()}

    def latestOffset(self) -> dict:
        return {"files": self._state()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for inode, now in end["files"].items():
            before = start["files"].get(inode)
            if now["rotated"] and not before:
                continue
            first = before["at"] if before else 0
            if before and (first > now["at"] or not self._same_head(now["path"], inode, before)):
                first = 0
            for lo in range(first, now["at"], self.split):
                out.append(Range(now["path"], inode, first, lo, min(lo + self.split, now["at"]), now["at"]))
        return out

    def _same_head(self, path: str, inode: str, before: dict) -> bool:
        path = self._find(path, inode)
        return path is None or head_of(path, before["n"]) == before["head"]

    def _find(self, path: str, inode: str) -> str | None:
        """Where the file is now: its path, or a rotated name."""
        for p in [path, *[p for p, _ in self._files()]]:
            try:
                if identity(p)[0] == inode:
                    return p
            except OSError:
                continue
        return None

    def read(self, partition: Range) -> Iterator[tuple]:
        path = self._find(partition.path, partition.inode)
        if path is None:
            logging.getLogger(__name__).warning("%s was removed before its last lines were read", partition.path)
            return
        tag = self.tag.replace("*", partition.path.strip("/").replace("/", "."))
        with open(path, "rb") as f:
            mtime = datetime.datetime.fromtimestamp(os.fstat(f.fileno()).st_mtime)
            at = partition.start
            if at > partition.first:    # the line across the cut belongs to the range before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.end:
                line = f.readline(partition.last - at)
                if not line:
                    return
                yield line.removesuffix(b"\n").decode(errors="replace"), partition.path, partition.inode, at, tag, mtime
                at += len(line)


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail(spark: SparkSession, path: str, tag: str = "file.*", **options):
    """A streaming DataFrame of the lines that are added to the files of ``path``
    (glob patterns, separated by commas)."""
    from ..session import configure
    configure(spark)
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("log_tail").option("path", path).option("tag", tag)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()

"""The tail source: growth, half lines, rotation, truncation, restarts, ranges."""
import os

from logsift.sources import tail as TL
from logsift.streaming import streams as R


def _write(path, data, mode="ab"):
    with open(path, mode) as f:
        f.write(data)


class Lines:
    """The reader driven by hand, as Spark drives it."""

    def __init__(self, **options):
        self.reader = TL.TailReader(options)
        self.at = self.reader.initialOffset()

    def next(self):
        end = self.reader.latestOffset()
        rows = [r for p in self.reader.partitions(self.at, end) for r in self.reader.read(p)]
        self.at = end
        return [(os.path.basename(r[1]), r[3], r[0]) for r in rows]


def test_growth_and_half_lines(tmp_dir):
    a = f"{tmp_dir}/a.log"
    _write(a, b"one\ntwo\nthr")
    _write(f"{tmp_dir}/b.txt", b"not tailed\n")
    t = Lines(path=f"{tmp_dir}/*.log")
    assert t.next() == [("a.log", 0, "one"), ("a.log", 4, "two")]
    assert t.next() == []
    _write(a, b"ee\n\nfour\n")
    assert t.next() == [("a.log", 8, "three"), ("a.log", 14, ""), ("a.log", 15, "four")]
    _write(f"{tmp_dir}/c.log", b"new file\n\xff\xfe bytes\n")
    assert t.next() == [("c.log", 0, "new file"), ("c.log", 9, "�� bytes")]


def test_rotation_takes_the_last_lines_of_the_old_file(tmp_dir):
    a = f"{tmp_dir}/a.log"
    _write(f"{tmp_dir}/a.log.9", b"long ago\n")
    _write(a, b"1\n")
    t = Lines(path=f"{tmp_dir}/*.log")
    assert t.next() == [("a.log", 0, "1")]
    _write(a, b"2\n3 without end")
    os.rename(a, a + ".1")
    _write(a, b"4\n")
    assert sorted(t.next()) == [("a.log", 0, "4"), ("a.log.1", 2, "2"), ("a.log.1", 4, "3 without end")]
    os.rename(a + ".1", a + ".2")
    _write(a, b"5\n")
    assert t.next() == [("a.log", 2, "5")]


def test_truncation(tmp_dir):
    a = f"{tmp_dir}/a.log"
    _write(a, b"first line\nsecond line\n")
    t = Lines(path=a)
    assert len(t.next()) == 2
    _write(a, b"x\n", "r+b")
    os.truncate(a, 2)
    assert t.next() == [("a.log", 0, "x")]
    # truncated and grown beyond the old position: the first bytes tell
    os.truncate(a, 0)
    _write(a, b"other text, longer than before\n")
    assert t.next() == [("a.log", 0, "other text, longer than before")]


def test_ranges_own_the_lines_that_start_in_them(tmp_dir):
    a = f"{tmp_dir}/a.log"
    lines = [f"line {i} " + "é" * (i % 13) for i in range(200)] + ["", "", "x" * 500, "end"]
    _write(a, ("\n".join(lines) + "\n").encode())
    for split in (1, 7, 64, 10_000):
        got = sorted(Lines(path=a, split_bytes=split).next(), key=lambda r: r[1])
        assert [r[2] for r in got] == lines


def test_tail_end_and_literal_tag(tmp_dir):
    a = f"{tmp_dir}/syslog"
    _write(a, b"old\n")
    t = Lines(path=a, tag="system.syslog", read_from_head="false")
    assert t.next() == []
    _write(a, b"new\n")
    end = t.reader.latestOffset()
    assert [(r[0], r[4]) for p in t.reader.partitions(t.at, end) for r in t.reader.read(p)] == [("new", "system.syslog")]
    wild = TL.TailReader({"path": a})
    row = next(wild.read(wild.partitions(wild.initialOffset(), wild.latestOffset())[0]))
    assert row[4] == "file." + a.strip("/").replace("/", ".")


def test_stream_over_appends_rotation_and_restart(spark, tmp_dir):
    d = f"{tmp_dir}/var"
    os.makedirs(d)
    a, out, ck = f"{d}/app.log", f"{tmp_dir}/t", f"{tmp_dir}/ck"
    _write(a, b"2024-01-01 00:00:00 ERROR 4004 svc-a failed\nplain\nplain\n")

    def run():
        q = R.start_logs_sink(R.growing_file_stream(spark, f"{d}/*.log", host="host-x", split_bytes=20), out, ck,
                              {"availableNow": True})
        q.awaitTermination()
        return spark.read.parquet(out).collect()

    rows = run()
    assert sorted(r["log_type"] for r in rows) == ["unknown", "unknown", "windows_event"]
    assert {r["source"] for r in rows} == {"host-x"} and len({r["log_id"] for r in rows}) == 3
    _write(a, b"appended\n")
    os.rename(a, a + ".1")
    _write(a, b"after rotation\nhalf")
    rows = run()    # a new query on the same checkpoint
    assert sorted(r["message"] for r in rows)[:2] == ["after rotation", "appended"] and len(rows) == 5
    assert len(run()) == 5

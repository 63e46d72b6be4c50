"""Fill-in-middle piece tables against string slicing."""
import hashlib
import re

import duckdb
import pytest

from logsift.llm import piece_table as P
from logsift.llm.common import prepare

TEXTS = [None, "", "a", " ", "abc def", "über 1 größe\n\tx", "日本語 text。", "a <P> b", "<S><M>", "<", "x<" * 40,
         "word " * 5000, "🎈" * 300, "ends with <P", "P> begins", "a\x00b"]


def brute(doc_id, text):
    text = text or ""
    t = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    pre, mid, suf = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, len(t), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(t), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(t), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.fixture(scope="module")
def rows():
    out = [(i * 17 + j, t, "clash") for i, t in enumerate(TEXTS) for j in range(12)]
    return out + [(None, "no id", "c"), (5, "twice", "c"), (5, "twice", "c"), (-3, "negative id", "c")]


def test_transform_and_restore(spark, rows):
    prepare(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)
    made = P.restore_rows(P.transform(docs)).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=key) == \
        sorted((brute(d, t) for d, t, _ in rows), key=key)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert sorted(r.restored for r in made) == sorted(t or "" for _, t, _ in rows)
    for r in made:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(r.restored.encode()).hexdigest()


def test_pieces_describe_the_output(spark, rows):
    for doc_id, text, _ in rows:
        n, form, out, *_ = P.transform_text(doc_id, text)
        buffers = ((text or "").encode(), P.SENTINELS)
        assert b"".join(buffers[b][s:s + k] for b, s, k in out.pieces).decode() == brute(doc_id, text)[5]
        if form != "plain":
            assert [b for b, *_ in out.pieces].count(P.MARKS) == 3


def test_cuts_split_descriptors_of_earlier_cuts():
    doc = P.PieceTable(b"0123456789")
    runs = doc.cut(0, 3, 3, 10)
    assert [doc.with_pieces(r).bytes() for r in runs] == [b"", b"012", b"", b"3456789", b""]
    moved = doc.with_pieces(runs[3] + runs[1])
    assert moved.bytes() == b"3456789012"
    assert [moved.with_pieces(r).bytes() for r in moved.cut(6, 8)] == [b"345678", b"90", b"12"]
    assert moved.with_pieces(moved.cut(7)[1] + moved.cut(7)[0]).bytes() == b"0123456789"


def test_sql_and_empty_table(spark, rows):
    prepare(spark)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(d, t) for d, t, _ in rows if t is None or "\x00" not in t])
    got = con.execute(P.OP13_SQL).fetchall()
    want = [(*b[:5], hashlib.sha256(b[5].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
            for d, t, _ in rows if t is None or "\x00" not in t for b in [brute(d, t)]]
    assert sorted(map(str, got)) == sorted(map(str, want))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.restore_rows(P.transform(empty)).collect() == []

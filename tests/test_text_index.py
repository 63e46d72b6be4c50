"""Trigram search equals the scan and reads fewer files."""
import pytest
from pyspark.sql import functions as F

from logsift.operators import text_index as X


@pytest.mark.parametrize("pattern, want", [
    ("connection refused", ["connection refused"]), ("took \\d+ ms", ["took ", " ms"]), ("(foo|bar)baz", ["baz"]),
    ("a(bcd)+e", ["a", "bcd", "e"]), ("x?yz", ["yz"]), ("ERR(OR)", ["error"]), ("[abc]def", ["def"]),
    ("foo.*bar", ["foo", "bar"]), ("(?:abc)def", ["abcdef"]), ("ab{2}c", ["a", "b", "c"]), ("é9abc", ["9abc"]), ("a|b", [])])
def test_literals(pattern, want):
    assert [x for x in X.literals(pattern) if x] == want


@pytest.mark.parametrize("pattern", ["\\p{L}abc", "\\Qa.b\\E", "(", "(?<n>abc)", "(?x) a b c"])
def test_other_syntax_is_scanned(pattern):
    assert not X.literals(pattern)


def test_search_equals_scan(spark, tmp_dir):
    words = ["disk failure on sda", "Connection REFUSED by peer", "user alice logged in", "took 15 ms", "élan vital 9abc", None, "", "ab"]
    for k in range(8):
        rows = [(i, words[(i * (k + 1)) % (k + 1)] if i % 9 else f"unique{k} token", f"host-{k}") for i in range(60)]
        spark.createDataFrame(rows, "id int, message string, source string").coalesce(1).write.parquet(f"{tmp_dir}/t/part={k}")
    index = X.TextIndex(spark, f"{tmp_dir}/t", f"{tmp_dir}/ix", ("message", "source"))
    assert index.refresh() == 8 and index.refresh() == 0
    table = spark.read.parquet(f"{tmp_dir}/t")

    def scan(p):
        return sorted((r.part, r.id) for r in table.where(F.col("message").rlike("(?i)" + p) | F.col("source").rlike("(?i)" + p)).collect())

    for p in ("connection refused", "CONNECTION", "took \\d+ ms", "unique3", "host-5", "a", "(alice|peer)", "élan", "vital 9", "nowhere",
              "^unique[12] token$", "log+ed", "\\p{L}an vital"):
        assert sorted((r.part, r.id) for r in index.search(p).collect()) == scan(p), p
    assert len(index.candidates("unique3")) == 1 and len(index.candidates("nowhere at all")) == 0
    assert len(index.candidates("a|b")) == 8
    assert len(index.search("unique3").inputFiles()) == 1
    # a file that came later is read until it is indexed
    spark.createDataFrame([(1, "unique3 again", "x")], "id int, message string, source string").coalesce(1).write.parquet(f"{tmp_dir}/t/part=9")
    assert {r.part for r in index.search("unique3").collect()} == {3, 9} and len(index.candidates("nowhere at all")) == 1
    assert index.refresh() == 1 and len(index.candidates("nowhere at all")) == 0

"""Seeds of the substring dedup against a brute force, and what the dedups leave on disk."""
import os

import numpy as np

from logsift.llm import substring_dedup as S
from logsift.llm.common import odd_constants, rolling, rolling_at
from logsift.llm.line_dedup import line_dedup


def _least(s):
    """The rightmost least of every eight, hashes compared without their place bits."""
    high = [int(x) >> 3 for x in s]
    return sorted({max(range(i, i + 8), key=lambda k: (-high[k], k)) for i in range(len(s) - 7)})


def test_selected_against_brute_force():
    rng = np.random.default_rng(5)
    for n in (8, 9, 30, 400):
        for top in (3, 40, 2**64 - 1):      # many ties, some, none
            s = rng.integers(0, top, n, np.uint64, endpoint=True) if top > 40 else rng.integers(0, top, n).astype(np.uint64) << np.uint64(3)
            assert S._selected(s).tolist() == _least(s)


def test_rolling_at():
    h = np.random.default_rng(6).integers(0, 2**64 - 1, 60, np.uint64)
    c = odd_constants(2, 20)
    at = np.array([0, 7, 40, 7])
    assert (rolling_at(h, c, at) == rolling(h, c)[at]).all()


def test_finished_tables_are_discarded(spark):
    """Only what the result still reads stays in the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir") + "/llm"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[5:30] + ["x"])), (3, None)], "doc_id long, text string")
    out = S.substring_dedup(docs)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left == {"lists", "hits"}
    assert {r.row.doc_id: (r.n_words, r.n_removed) for r in out.collect()} == {1: (40, 0), 2: (26, 25), 3: (0, 0)}


def test_line_dedup_keeps_no_wide_tables(spark):
    folder = spark.conf.get("spark.checkpoint.dir") + "/llm"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    a = "the quick brown fox jumps over the lazy dog near the river"
    docs = spark.createDataFrame([(1, a + "\nalone here and now"), (2, a.replace("lazy", "lasy")), (3, None)], "doc_id long, text string")
    out = line_dedup(docs)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert not left & {"lines", "classes", "near-words", "near-grams", "norms-words", "norms-grams"}
    assert {r.row.doc_id: (r.n_lines, r.n_removed) for r in out.collect()} == {1: (2, 0), 2: (1, 1), 3: (0, 0)}

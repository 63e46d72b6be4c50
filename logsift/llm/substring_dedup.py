"""Substring dedup by seed and extend.

Every 13-word window selects one seed: the 6-word shingle of least hash
(rightmost on ties) among its eight - winnowing, so equal windows select equal
seeds.  Documents are joined on seeds; a shared seed is then extended both
ways:

1. *Seeds.*  Seeds found in two or more documents (``min < max`` document per
   seed, pre-aggregated) are joined back to their documents.
2. *Full extension.*  A seed occurrence and up to seven words on either side
   hold every window that covers the seed.  Where a smaller document has the
   same extended seed, all those windows repeat.
3. *Partial extension.*  Where the extension breaks (ends of a repeat, changed
   words), each 13-word alignment of the seed is compared by itself, for the
   seeds that still have an unexplained occurrence.
4. Overlapping repeats merge into maximal ones; their words go.

No pair of documents is ever built: each step aggregates the smallest document
per key and joins it back, so a passage in a third of all documents costs one
row per document.  Keys are 128 bits wide.  Windows are judged on the input.

Edge cases: null and empty texts have no words; texts under 13 words lose
nothing; rows with a null ``doc_id`` give and lose nothing; rows that repeat a
``doc_id`` are judged each, an equal id is not smaller; other columns pass
through untouched, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, odd_constants, rolling, rolling_at, signed, stage, table, word_hashes, words_of

WINDOW = 13
SEED = 6                    # words of a seed
SPREAD = WINDOW - SEED      # words a window reaches past its seed on one side; one less than a power of two

_C_SEED = odd_constants(1, SEED)
_C_CTX = odd_constants(2, SEED + 2 * SPREAD)
_C_W1, _C_W2 = odd_constants(3, WINDOW), odd_constants(4, WINDOW)


def _selected(s: np.ndarray) -> np.ndarray:
    """Positions of the least of every ``SPREAD + 1`` consecutive hashes, the
    rightmost on ties.  The place in the window takes the low bits."""
    m = len(s) - SPREAD
    low = np.uint64(SPREAD)
    high = s & ~low
    least = high[:m] | low
    for j in range(1, SPREAD + 1):
        np.minimum(least, high[j:j + m] | np.uint64(SPREAD - j), out=least)
    pos = np.arange(SPREAD, len(s)) - (least & low).astype(np.int64)
    return pos[np.flatnonzero(np.diff(pos, prepend=-1))]     # they never go back


def _seeds(text: str | None, extend: bool = True):
    """Word hashes, and position, seed hash and (if asked for) extended-seed hash
    of each selected seed; None for texts under one window."""
    words = words_of(text)
    if len(words) < WINDOW:
        return None
    h = word_hashes(words)
    s = rolling(h, _C_SEED)
    pos = _selected(s)
    if not extend:
        return words, h, pos, s[pos], None
    pad = np.zeros(SPREAD, np.uint64)   # beyond an end of the document
    return words, h, pos, s[pos], rolling_at(np.concatenate([pad, h, pad]), _C_CTX, pos)


def _rows(it, columns, fn):
    """Run ``fn(doc_id, text, *lists)`` -> arrays per document; emit their rows."""
    for b in it:
        cols = [b.column(i).to_pylist() if i < 2 else b.column(i).to_numpy(zero_copy_only=False)
                for i in range(b.num_columns)]
        ids, parts = [], []
        for row in zip(*cols):
            out = fn(*row)
            if out is not None and len(out[0]):
                ids.append((row[0], len(out[0])))
                parts.append(out)
        if parts:
            doc = np.repeat(np.array([i for i, _ in ids], np.int64), [n for _, n in ids])
            arrays = [np.concatenate(p) for p in zip(*parts)]
            arrays = [signed(a) if a.dtype == np.uint64 else a for a in arrays]
            yield pa.RecordBatch.from_arrays([pa.array(doc), *map(pa.array, arrays)],
                                             names=["doc_id", *columns])


def _seed_rows(it):
    def fn(_, text):
        s = _seeds(text, extend=False)
        return s and (np.unique(s[3]),)
    return _rows(it, ["a"], fn)


def _extended_rows(it):
    def fn(_, text, shared, mine):
        s = _seeds(text)
        a, c = signed(s[3]), signed(s[4])
        keep = np.isin(a, shared)
        _, first = np.unique(c[keep], return_index=True)
        a, c = a[keep][first], c[keep][first]
        return a, c, np.isin(a, mine)
    return _rows(it, ["a", "c", "later"], fn)


def _aligned(h, pos):
    """Starts of all windows that cover the seeds at ``pos``."""
    at = (pos[:, None] - np.arange(SPREAD + 1)[None, :]).ravel()
    return np.unique(at[(at >= 0) & (at <= len(h) - WINDOW)])


def _window_rows(it):
    def fn(_, text, need):
        _, h, pos, _, c = _seeds(text)
        at = _aligned(h, pos[np.isin(signed(c), need)])
        w1, w2 = rolling_at(h, _C_W1, at), rolling_at(h, _C_W2, at)
        _, first = np.unique(w1, return_index=True)
        return w1[first], w2[first]
    return _rows(it, ["w1", "w2"], fn)


def _cut(text, whole, hits):
    words = words_of(text)
    gone = np.zeros(len(words), bool)
    if (whole is not None and len(whole)) or (hits is not None and len(hits)):
        _, h, pos, _, c = _seeds(text)
        starts = np.zeros(len(h) + 1, np.int64)
        if whole is not None and len(whole):
            starts[_aligned(h, pos[np.isin(signed(c), whole)])] = 1
        if hits is not None and len(hits):
            starts[np.flatnonzero(np.isin(signed(rolling(h, _C_W1)), hits))] = 1
        at = np.flatnonzero(starts)
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        gone = np.cumsum(edge[:-1]) > 0
    n = int(gone.sum())
    return len(words), n, b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if n else words).decode()


def _cut_rows(it):
    for b in it:
        n = b.num_columns
        whole, hits = (b.column(i).to_numpy(zero_copy_only=False) for i in (n - 2, n - 1))
        out = [_cut(t, w, x) for t, w, x in zip(b.column(0).to_pylist(), whole, hits)]
        yield pa.RecordBatch.from_arrays(
            [b.column(1), pa.array([o[0] for o in out], pa.int64()),
             pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())],
            names=["row", "n_words", "n_removed", "kept_text"])


def _shared_seeds(docs: DataFrame) -> DataFrame:
    """Per document its seeds found in other documents too (``shared``), and
    those found in a smaller document (``mine``)."""
    a = stage(docs.mapInArrow(_seed_rows, "doc_id long, a long"), "seeds")
    both = (a.groupBy("a").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x"))
            .where("m < x").select("a", "m"))
    found = a.join(both, "a").groupBy("doc_id").agg(
        F.collect_list("a").alias("shared"),
        F.collect_list(F.when(F.col("m") < F.col("doc_id"), F.col("a"))).alias("mine"))
    out = stage(found, "shared")
    discard(a)
    return out


def _extended(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """Per document the extended seeds that repeat as a whole (``whole``) and
    those to be compared window by window (``need``)."""
    b = stage(docs.join(shared, "doc_id").select("doc_id", "text", "shared", "mine")
              .mapInArrow(_extended_rows, "doc_id long, a long, c long, later boolean"), "extended")
    first = b.groupBy("a", "c").agg(F.min("doc_id").alias("m"))
    j = stage(b.join(first, ["a", "c"]).select(
        "doc_id", "a", "c", "later", (F.col("m") < F.col("doc_id")).alias("whole")), "resolved")
    discard(b)
    open_seeds = j.where("later and not whole").select("a").distinct()
    need = j.where("not whole").join(open_seeds, "a", "left_semi").select(
        "doc_id", F.lit(None).cast("long").alias("whole"), F.col("c").alias("need"))
    done = j.where("whole").select("doc_id", F.col("c").alias("whole"), F.lit(None).cast("long").alias("need"))
    out = stage(done.union(need).groupBy("doc_id").agg(
        F.collect_list("whole").alias("whole"), F.collect_list("need").alias("need")), "lists")
    discard(j)
    return out


def _hits(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Per document the windows of step 3 that a smaller document has."""
    need = lists.where(F.size("need") > 0).select("doc_id", "need")
    w = stage(docs.join(need, "doc_id").select("doc_id", "text", "need")
              .mapInArrow(_window_rows, "doc_id long, w1 long, w2 long"), "windows")
    first = (w.groupBy("w1", "w2").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x"))
             .where("m < x").select("w1", "w2", "m"))
    out = stage(w.join(first, ["w1", "w2"]).where("doc_id > m")
                .groupBy("doc_id").agg(F.collect_list("w1").alias("hits")), "hits")
    discard(w)
    return out


def substring_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, anything else) -> row (all input columns as a
    struct), n_words, n_removed, kept_text (kept words joined by one space)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        "doc_id is not null and text is not null")
    shared = _shared_seeds(slim)
    lists = _extended(slim, shared)
    discard(shared)
    marks = lists.select("doc_id", "whole").join(_hits(slim, lists), "doc_id", "full")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.join(marks, "doc_id", "left").select("text", "row", "whole", "hits")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept_text string"
    return out.mapInArrow(_cut_rows, schema)


def op10_substring_dedup(spark, sf_dir):
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed",
                      F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s+12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, s + i AS p FROM rep, range(0, 13) t(i)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS t
         FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

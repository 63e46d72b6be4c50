"""Packing by shortest-pack-first over the length histogram (Krell et al. 2021).

1. Every document becomes its ids plus the end id, cut into pieces of the
   sequence length and one rest.
2. The histogram of piece lengths (at most 2048 rows, whatever the corpus) goes
   to the driver.  Lengths are placed longest first; each goes to the packs
   with the most room (the shortest) that still fit it, changing counts of
   packing patterns.
3. Pieces are numbered within their length - first within (length, salt), then
   shifted by the counts before that salt, so a length that a third of all
   pieces share is spread - and a pattern slot owns a range of these ranks,
   which gives sequence and offset.

Edge cases: null and empty texts are one end id; rows that repeat a doc_id are
packed each; a null doc_id stays null; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, table
from .tokens import id_bytes

LENGTH = 2048
END_ID = 1
ROWS_PER_SALT = 20_000      # pieces of one length numbered in one group, about


def _pieces(length, ranks_path):
    def run(it):
        encode = id_bytes(ranks_path)
        end = np.array([END_ID], "<u4").tobytes()
        for b in it:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                for s in range(0, n, length):
                    part = ids[4 * s:4 * (s + length)]
                    out.append((doc, s, len(part) // 4, zlib.crc32(part), n))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


def pack_histogram(hist: dict[int, int], size: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in placing order, count) that use up ``hist``.  The
    number of patterns is bounded by the number of lengths, not of pieces:
    each step empties a pattern into a longer one or ends a length."""
    room: dict[int, dict[tuple, int]] = defaultdict(dict)

    def put(pattern, n):
        if n:
            packs = room[size - sum(pattern)]
            packs[pattern] = packs.get(pattern, 0) + n

    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            space = max((s for s in room if s >= length), default=None)
            if space is None:       # new packs, each filled with this length
                per = size // length
                whole, rest = divmod(left, per)
                put((length,) * per, whole)
                put((length,) * rest, 1 if rest else 0)
                break
            pattern, n = room[space].popitem()
            fit = min(space // length, -(-left // n))     # of this length into each
            take = min(n, left // fit)
            put(pattern, n - take)
            if not room[space]:
                del room[space]
            put(pattern + (length,) * fit, take)
            left -= take * fit
    return sorted((p, n) for packs in room.values() for p, n in packs.items())


def _ranks(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``, a gapless number from 0 within their length."""
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / ROWS_PER_SALT)).cast("long")
    counts = pieces.groupBy("length").count().withColumnRenamed("count", "n")
    order = ["doc_id", "start", "ids_crc32"]
    salted = stage(pieces.join(F.broadcast(counts), "length")    # at most 2048 lengths
                   .withColumn("salt", F.pmod(F.xxhash64(*order), salts)).drop("n"), "salted")
    part = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = part.select("length", "salt", (F.sum("n").over(
        Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1
    return (salted.withColumn("own", own).join(before, ["length", "salt"])
            .withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "salt"))


def _placed(slots):
    key, lo, base, offset = slots

    def run(it):
        for b in it:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(5)] +
                [pa.array(base[at] + rank - lo[at]), pa.array(offset[at])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, length: int = LENGTH, ranks_path: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) -> one row per piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stage(src.mapInArrow(
        _pieces(length, ranks_path),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    # at most ``length`` rows
    hist = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    used, sequence, slots = defaultdict(int), 0, []
    for pattern, n in pack_histogram(hist, length):
        offset = 0
        for part in pattern:
            slots.append((part, used[part], sequence, offset))
            used[part] += n
            offset += part
        sequence += n
    slots.sort()
    size, lo, base, offset = (np.array(c, np.int64) for c in zip(*slots)) if slots else [np.zeros(0, np.int64)] * 4
    return _ranks(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(
        _placed(((size << 48) + lo, lo, base, offset)),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op4_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))

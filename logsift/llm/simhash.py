"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, 3-word shingles
with repeats (fewer words: the whole sequence), XXH64 (seed 42); a bit is set
if it is set in over half of the hashes; no word: zero.

Covering tables (Pagh 2016): bit i carries a vector m(i) of radius+1 bits, and
table v (each non-zero vector) keeps the bits with <m(i), v> = 1.  For up to
``radius`` differing bits some v is orthogonal to all their vectors, so every
pair within the radius collides in some table - with radius 2 in one of seven.

Inside a bucket fingerprints are linked without building its pairs: two
fingerprints differ in at most 2 bits exactly if they share a midpoint at
distance at most 1 from both.  Each one emits itself and its one-bit
neighbours among the bits that the table drops; a midpoint has at most one
fingerprint per dropped bit plus itself, so groups are bounded by 65 whatever
the size of a bucket, and the distance check is exact.

Edge cases: null and empty texts have fingerprint zero, linked like any other;
repeated rows and ids share a class; a null ``doc_id`` gets the class of its
fingerprint (null if no other row has an id); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, signed, stage, table

BITS = 64
SHINGLE = 3
RADIUS = 2


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split() if text else []   # bytes.lower: A-Z only
    if not words:
        return 0
    norm = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(norm, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        h = np.fromiter((digest(norm[s:e], 42) for s, e in
                         zip(starts[lo:hi].tolist(), ends[lo + shingle - 1:hi + shingle - 1].tolist())),
                        np.uint64, hi - lo)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(it):
    for b in it:
        fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed(fp))], names=["doc_id", "fp"])


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Bit masks of the covering tables, as signed 64-bit values."""
    n = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, n + 1):
        m = sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() % 2)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints (column ``fp``,
    distinct) within 2 bits of each other, directly or over others."""
    if radius != 2:
        raise ValueError("the midpoint check is exact for radius 2")
    masks = covering_masks(radius)
    rows = stage(fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k"))
        for t, m in enumerate(masks)])).alias("x")).select("fp", "x.t", "x.k"), "tables")
    crowded = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1").select("t", "k")
    near = rows.join(crowded, ["t", "k"])
    flips = F.create_map(*[x for t, m in enumerate(masks) for x in (
        F.lit(t), F.array(*[F.lit(0)] + [F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i)
                                         for i in range(BITS) if not (m >> i) & 1]))])
    mid = near.select("t", "fp", F.explode(flips[F.col("t")]).alias("bit")).select(
        "t", F.col("fp").bitwiseXOR(F.col("bit")).alias("z"), "fp")
    met = mid.groupBy("t", "z").agg(F.collect_set("fp").alias("s")).where(F.size("s") > 1)
    return met.select(F.array_min("s").alias("u"), F.explode("s").alias("v")).where("u <> v").distinct()


def simhash_groups(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, fp (signed 64-bit), component_id
    (smallest doc_id reachable)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _grouped(stage(rows.mapInArrow(_fingerprints, "doc_id long, fp long"), "fp"))


def _grouped(fp: DataFrame) -> DataFrame:
    classes = stage(fp.groupBy("fp").agg(F.min("doc_id").alias("d")), "classes")
    comp = connected_components(links(classes))
    of = classes.join(comp, classes.fp == comp.node, "left").select(
        "fp", "d", F.coalesce("component", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("d").alias("component_id"))
    return fp.join(of.join(least, "component").select("fp", "component", "component_id"), "fp")


def _with_text_key(it):
    for b in it:
        fp = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(signed(fp))], names=["doc_id", "text_key", "fp"])


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the smallest doc_id (rows without
    an id last; then by a hash of the text).  Of rows that repeat id and text one
    stays."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"), "text")
    fp = stage(rows.mapInArrow(_with_text_key, "doc_id long, text_key long, fp long"), "fp")
    of = _grouped(fp.select("doc_id", "fp")).select("fp", "component").distinct()
    first = fp.join(of, "fp").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("text_key"))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), key.alias("text_key"))
    same = whole["id"].eqNullSafe(kept["id"]) & (whole["text_key"] == kept["text_key"])
    return whole.join(kept, same, "left_semi").dropDuplicates(["id", "text_key"]).select("row.*")


def op5_simhash_near_dedup(spark, sf_dir):
    g = simhash_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id",
                    F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

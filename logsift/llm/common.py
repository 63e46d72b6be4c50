"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, ensure_checkpoint_dir

_M64 = (1 << 64) - 1


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: small Arrow batches, because a row
    holds a whole document."""
    configure(spark)
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet into the shared checkpoint folder and read it
    back: the lineage is cut, lost executors cost only the running step, and
    the shuffle files of finished steps become garbage, which the JVM is asked
    to collect so that their disk is free for the next step."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.staged_at = path
    return out


def release(spark: SparkSession) -> None:
    """Before a step that needs much disk: let go of the shuffle files of all
    finished steps, those of the last one included (its end has to reach the
    listeners first)."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(table: DataFrame) -> None:
    """Remove the files of a table made by ``stage`` that no later step reads."""
    path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.staged_at)
    path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def splitmix(i: int) -> int:
    """One step of the splitmix64 generator: a 64-bit value from an integer."""
    z = (i * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & _M64
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M64
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M64
    return z ^ (z >> 31)


def odd_constants(seed: int, n: int) -> np.ndarray:
    return np.array([splitmix(seed * 1000 + i) | 1 for i in range(n)], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over an array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8 (null: none).
    ``bytes.split`` separates at exactly these six characters."""
    return text.encode().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(h: np.ndarray, constants: np.ndarray) -> np.ndarray:
    """Hash of every run of ``len(constants)`` consecutive values."""
    k = len(constants)
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(m, np.uint64)
    for j in range(k):
        acc += h[j:j + m] * constants[j]
    return mix64(acc)


def rolling_at(h: np.ndarray, constants: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``rolling`` at some positions."""
    acc = np.zeros(len(at), np.uint64)
    for j, c in enumerate(constants):
        acc += h[at + j] * c
    return mix64(acc)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as edges (u, v) of longs, as
    (node, component) with the smallest node as component; only nodes of an
    edge between different nodes appear.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each
    round is two aggregations and two joins on the edge table, so no component
    is ever gathered, and a hub is pre-aggregated (its minimum) and split by
    the skew join.  Rounds end when the edge set stops changing; each one is
    written to the shared folder.
    """
    e = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
              .where("u <> v").distinct(), "cc")

    def signature(df):
        r = df.agg(F.count("*").alias("n"),
                   F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    last = signature(e)
    for _ in range(max_rounds):
        if not last[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).union(low))
        e = stage(small.distinct(), "cc")
        now = signature(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

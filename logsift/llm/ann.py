"""Approximate nearest neighbours by learned partitions.

1. *Fit* on a bounded sample (``SAMPLE`` vectors of least hash): the neighbour
   graph of the sample is cut into ``PARTS`` balanced partitions by restreamed
   greedy assignment (neighbours in the part, less a charge for its size), and
   a small network learns a vector's part from the vector.
2. *Index*: every row goes to its most probable part, in blocks of about
   ``BLOCK`` rows, as many as the part needs (a hot part has many blocks).
3. *Search*: a query goes to its most probable parts - as many as the held-out
   quarter of the sample needs for ``RECALL`` - and meets their blocks; each block returns its five nearest by exact cosine in double
   precision, equal values by smaller vec_id, and the best five of these stay.

Recall against brute force is measured in tests/llm/test_text_operators.py (at least 0.9).

Edge cases: vectors that are null, zero, hold null or non-finite components, or
have another length than most of the sample take no part; rows that repeat a
vec_id count once (the smallest vector); a null vec_id takes no part; fewer
than five candidates give fewer rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, table

SAMPLE = 4096
PARTS = 16
RECALL = 0.94              # wanted on the held-out part of the sample
GRAPH_K = 10
BLOCK, QUERY_BLOCK = 2000, 500
TOP = 5
EVERY = 50


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced_parts(x: np.ndarray, parts: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Part of each row of ``x`` (unit vectors), and its neighbour table."""
    n = len(x)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    near = np.argsort(-sims, axis=1, kind="stable")[:, :min(GRAPH_K, n - 1)]
    both = [set(r) for r in near.tolist()]
    for i, r in enumerate(near.tolist()):
        for j in r:
            both[j].add(i)
    order, seen = [], set()     # breadth first, so neighbours follow each other
    for s in range(n):
        queue = [s]
        while queue:
            v = queue.pop()
            if v not in seen:
                seen.add(v)
                order.append(v)
                queue += sorted(both[v] - seen)
    limit = 1.1 * n / parts
    part, size = np.full(n, -1), np.zeros(parts)
    for r in range(rounds):
        charge = GRAPH_K * 0.5 * (r + 1) / rounds
        for v in order:
            if part[v] >= 0:
                size[part[v]] -= 1
            mine = part[list(both[v])]
            gain = np.bincount(mine[mine >= 0], minlength=parts) - charge * size / limit
            gain[size >= limit] = -np.inf
            part[v] = int(gain.argmax())
            size[part[v]] += 1
    return part, near


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 64, steps: int = 200, seed: int = 7):
    """One hidden layer, Adam on the whole sample; ``target`` are shares of parts."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, (1 / hidden) ** 0.5, (hidden, target.shape[1])), np.zeros(target.shape[1])]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        h = np.maximum(x @ p[0] + p[1], 0)
        z = h @ p[2] + p[3]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        d = (e / e.sum(axis=1, keepdims=True) - target) / len(x)
        dh = (d @ p[2].T) * (h > 0)
        for i, g in enumerate((x.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] -= 0.01 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-9)
    return p


def _logits(p, x):
    return np.maximum(x @ p[0] + p[1], 0) @ p[2] + p[3]


def fit(sample: np.ndarray, parts: int = PARTS, recall: float = RECALL):
    """Router and number of probes: the fewest whose parts hold the wanted
    share of the five nearest sample vectors of the held-out quarter, which the
    router has not seen.  Neighbours in the whole table are nearer than those in
    the sample, so this errs on the safe side."""
    x = _unit(np.unique(sample, axis=0))      # equal vectors say nothing about parts
    x = x[np.random.default_rng(5).permutation(len(x))]
    parts = max(1, min(parts, len(x) // 32))
    if parts == 1:
        return [np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1
    asked, seen = x[:len(x) // 4], x[len(x) // 4:]
    part, near = balanced_parts(seen, parts)
    target = np.zeros((len(seen), parts))
    for j in range(near.shape[1]):
        np.add.at(target, (np.arange(len(seen)), part[near[:, j]]), 1.0)
    np.add.at(target, (np.arange(len(seen)), part), float(near.shape[1]))
    scale = x.shape[1] ** 0.5
    net = train_router(seen * scale, target / target.sum(axis=1, keepdims=True))
    home = _logits(net, seen * scale).argmax(axis=1)
    tops = home[np.argsort(-(asked @ seen.T), axis=1)[:, :TOP]]
    place = np.argsort(np.argsort(-_logits(net, asked * scale), axis=1), axis=1)    # of each part, by probability
    found = np.take_along_axis(place, tops, axis=1)
    share = [(found < p).mean() for p in range(1, parts + 1)]
    return net, next(p for p, s in enumerate(share, 1) if s >= recall)


def _matrix(col) -> np.ndarray:
    a = np.asarray(col.flatten(), np.float64)
    return a.reshape(len(col), -1) if len(col) else a.reshape(0, 1)


def _routed(net, probes):
    def run(it):
        for b in it:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            z = _logits(net, _unit(x) * x.shape[1] ** 0.5)
            best = np.argsort(-z, axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(list(best), pa.list_(pa.int32()))], names=["vec_id", "v", "parts"])
    return run


def _nearest(it):
    for b in it:
        for qid, q, cid, c in zip(*(b.column(n) for n in ("qid", "q", "cid", "c"))):
            qi, ci = (np.asarray(x.values, np.int64) for x in (qid, cid))
            qv, cv = _matrix(q.values), _matrix(c.values)
            qn, cn = np.linalg.norm(qv, axis=1), np.linalg.norm(cv, axis=1)
            approx = (qv / qn[:, None]) @ (cv / cn[:, None]).T
            ids, found, scores = [], [], []
            for i in range(len(qi)):
                s = approx[i]
                s[ci == qi[i]] = -np.inf
                k = min(TOP, int((s > -np.inf).sum()))
                if not k:
                    continue
                at = np.flatnonzero(s >= np.partition(s, -k)[-k] - 1e-9)
                exact = (cv[at] * qv[i]).sum(axis=1) / (cn[at] * qn[i])
                at, exact = (x[np.lexsort((ci[at], -exact))[:k]] for x in (at, exact))
                ids += [qi[i]] * k
                found += ci[at].tolist()
                scores += exact.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())],
                names=["query_id", "vec_id", "score"])


def _blocks(rows: DataFrame, size: int, ids: str, vectors: str) -> DataFrame:
    """(part, ids, vectors) in blocks of about ``size`` rows."""
    n = rows.groupBy("part").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / size).cast("long"))
    return (rows.join(F.broadcast(n), "part").withColumn("block", block)      # one row per part
            .groupBy("part", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("x"))
            .select("part", F.col("x.vec_id").alias(ids), F.col("x.v").alias(vectors)))


def search(vectors: DataFrame, every: int = EVERY, parts: int = PARTS, recall: float = RECALL) -> DataFrame:
    """``vectors`` (vec_id, embedding) -> query_id, rank, vec_id, score for the
    rows whose vec_id is divisible by ``every``."""
    v = F.col("embedding").cast("array<double>")
    ok = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists("v", lambda x: x != 0)
    clean = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null")
             .where(F.coalesce(ok, F.lit(False))).groupBy("vec_id").agg(F.min("v").alias("v")))
    # at most SAMPLE vectors
    sample = [r["v"] for r in clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]
    schema = "query_id long, vec_id long, score double"
    if not sample:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = Counter(map(len, sample)).most_common(1)[0][0]
    net, probes = fit(np.array([x for x in sample if len(x) == width]), parts, recall)
    rows = stage(clean.where(F.size("v") == width).mapInArrow(
        _routed(net, probes), "vec_id long, v array<double>, parts array<int>"), "routed")
    index = _blocks(rows.select("vec_id", "v", F.col("parts")[0].alias("part")), BLOCK, "cid", "c")
    asked = _blocks(rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.explode("parts").alias("part")),
                    QUERY_BLOCK, "qid", "q")
    met = asked.join(index, "part").select("qid", "q", "cid", "c").repartition(
        vectors.sparkSession.sparkContext.defaultParallelism * 4)
    found = met.mapInArrow(_nearest, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
            .select("query_id", "rank", "vec_id", "score"))


def op8_nearest_neighbours(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))

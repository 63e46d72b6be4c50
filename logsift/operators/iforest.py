"""Isolation-forest detector over hourly feature rows, after Liu, Ting
and Zhou, "Isolation Forest" (ICDM 2008), as relational tree induction.

* Features (A20) come from one partial ``groupBy`` of the log rows per hour;
  their number is the time span in hours, not the number of log rows.
* Draws: a uniform number in [0, 1) is the md5 of seed, tree and what is drawn,
  so the forest is the same on every cluster and in SQL.
* Sub-sampling: a tree's sample is its ``min(256, n)`` smallest draws over the
  hours.
* Induction, level by level: the rows of a node (tree, path) give the range of
  each feature; one of the features that vary is drawn, then a split uniform in
  its range; rows below go left.  A node ends at one row, without a feature that
  varies, or at depth ceil(log2(psi)).  All trees grow at once; a node has at
  most 256 rows.  Splits are uniform in a feature's range, so standard scaling
  of the features would not change any of them and is left out.
* Scoring: the forest has at most ``trees x (2 psi - 1)`` nodes (51,100 for the
  defaults), a proven bound, so it is broadcast; each (hour, tree) walks down one
  equi-join a level, once.  score = 2^(-E[h(x)] / c(psi)); decision = -score -
  (10th percentile of -score); an outlier has decision < 0.

Path lengths are summed as whole billionths and scores rounded at 12 decimals:
neither depends on the order of a sum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..session import configure, ensure_checkpoint_dir
from .anomalies import _details, fmt, recent_logs
from .stats import hourly_features

FEATURES = ("n_logs", "n_errors", "n_templates", "n_sources", "hour_of_day", "day_of_week")
EULER_GAMMA = 0.5772156649015329
UNIT = 1_000_000_000        # path lengths are summed in these parts
DIGITS = 12                 # hex digits of a draw


def average_path_length(n: Column) -> Column:
    """c(n): mean path length of an unsuccessful search in a binary tree."""
    m = n.cast("double")
    return F.when(n > 2, 2.0 * (F.ln(m - 1.0) + EULER_GAMMA) - 2.0 * (m - 1.0) / m).when(n == 2, 1.0).otherwise(0.0)


def path_length_of(n: int) -> float:
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n if n > 2 else float(n == 2)


def draw(*parts) -> Column:
    """A uniform number in [0, 1) from the text of ``parts``."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / float(16 ** DIGITS)


def _depth_limit(psi: int) -> int:
    return int(math.ceil(math.log2(max(psi, 2))))


def grow(features: DataFrame, n_trees: int, psi: int, seed: int) -> DataFrame:
    """The forest as rows (tree, node, feature, threshold, size, depth): node 1 is
    the root, 2i and 2i + 1 the children of i; a leaf has no feature."""
    rows = features.select("hour", F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("x"),
                           F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
    # the one shuffle: every window below is within a tree
    rows = rows.repartition(min(n_trees, features.sparkSession.sparkContext.defaultParallelism), "tree")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(
        draw(seed, F.lit("s"), F.col("tree"), F.unix_seconds("hour")), "hour"))
    rows = (rows.withColumn("_r", rank).where(F.col("_r") <= psi).drop("_r", "hour").selectExpr(
        "tree", "x", "1L AS node",
        "cast(array() AS array<struct<node:bigint,feature:int,threshold:double,size:bigint,depth:int>>) AS path"))
    limit = _depth_limit(psi)
    bounds = ", ".join(f"struct({i} AS f, min(x[{i}]) OVER own AS lo, max(x[{i}]) OVER own AS hi)"
                       for i in range(len(FEATURES)))

    def u(kind):
        return (f"(cast(conv(substring(md5(concat_ws('|', '{seed}', '{kind}', cast(tree AS string), cast(node AS string))), "
                f"1, {DIGITS}), 16, 10) AS double) / {16 ** DIGITS}D)")

    own = "(PARTITION BY tree, node)"
    ranges = bounds.replace("OVER own", f"OVER {own}")
    for depth in range(limit + 1):
        # later columns of the second list refer to earlier ones; node and path are those of the level above
        rows = rows.selectExpr("tree", "x", "path", "node", f"count(1) OVER {own} AS size", f"array({ranges}) AS ranges").selectExpr(
            "tree", "x",
            f"CASE WHEN node IS NOT NULL AND {depth} < {limit} AND size > 1 THEN filter(ranges, b -> b.hi > b.lo) END AS usable",
            f"get(usable, cast(floor({u('f')} * size(usable)) AS int)) AS split",
            f"split.lo + {u('t')} * (split.hi - split.lo) AS threshold",
            f"CASE WHEN node IS NOT NULL THEN concat(path, array(struct(node, split.f AS feature, threshold, size, {depth} AS depth))) "
            "ELSE path END AS path",
            "CASE WHEN split.f IS NOT NULL THEN 2 * node + CASE WHEN get(x, split.f) < threshold THEN 0 ELSE 1 END END AS node")
    return rows.select("tree", F.explode("path").alias("p")).select("tree", "p.*").distinct()


def path_lengths(features: DataFrame, forest: DataFrame, n_trees: int, psi: int) -> DataFrame:
    """(hour, total): sum over the trees of depth + c(size) at the reached leaf,
    in ``UNIT`` parts."""
    nodes = F.broadcast(forest.select(   # at most n_trees x (2 psi - 1) rows
        "tree", "node", "feature", "threshold", F.round((F.col("depth") + average_path_length(F.col("size"))) * UNIT)
        .cast("long").alias("h")))
    at = features.select("hour", F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("x"),
                         F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"),
                         F.lit(1).cast("long").alias("node"), F.lit(None).cast("long").alias("done"))
    for depth in range(_depth_limit(psi) + 1):
        # a side of a split that no sampled row took is an empty leaf
        step = at.join(nodes, ["tree", "node"], "left")
        ends = F.col("node").isNotNull() & F.col("feature").isNull()
        at = step.select(
            "hour", "x", "tree",
            F.when(F.col("feature").isNotNull(), 2 * F.col("node") + F.when(
                F.get("x", F.col("feature")) < F.col("threshold"), 0).otherwise(1)).alias("node"),
            F.when(ends, F.coalesce("h", F.lit(depth * UNIT).cast("long"))).otherwise(F.col("done")).alias("done"))
    return at.groupBy("hour").agg(F.sum("done").alias("total"))


def isolation_scores(features: DataFrame, n_trees: int = K.IFOREST_TREES,
                     max_samples: int = K.IFOREST_MAX_SAMPLES, seed: int = K.IFOREST_SEED,
                     contamination: float = K.IFOREST_CONTAMINATION) -> DataFrame:
    """Feature rows (hour + FEATURES) -> + anomaly_score, decision, is_outlier."""
    spark = features.sparkSession
    configure(spark)
    ensure_checkpoint_dir(spark)
    psi = min(max_samples, features.count())
    if psi < 2:
        return features.select("hour", *FEATURES, F.lit(None).cast("double").alias("anomaly_score"),
                               F.lit(None).cast("double").alias("decision"),
                               F.lit(False).alias("is_outlier")).where(F.lit(False))
    forest = grow(features, n_trees, psi, seed).checkpoint(eager=True)
    total = path_lengths(features, forest, n_trees, psi)
    mean = F.col("total") / float(UNIT) / float(n_trees)
    scored = total.select("hour", F.round(F.pow(F.lit(2.0), -mean / path_length_of(psi)), 12).alias("anomaly_score"))
    scored = features.join(scored, "hour").checkpoint(eager=True)    # one row an hour, read twice below
    offset = scored.agg(F.percentile(-F.col("anomaly_score"), contamination)).first()[0]    # one number
    out = scored.withColumn("decision", F.round(-F.col("anomaly_score") - F.lit(offset), 12))
    return out.select("hour", *FEATURES, "anomaly_score", "decision", (F.col("decision") < 0).alias("is_outlier"))


def detect_ml(logs: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """ML_DETECTED_ANOMALY for outlier hours (needs >= 100 rows and >= 24
    hourly feature rows)."""
    rec = recent_logs(logs, as_of, hours)
    # one row per hour; written once to the shared checkpoint folder because
    # the size check, the sampling and the scoring all read it
    ensure_checkpoint_dir(logs.sparkSession)
    feats = hourly_features(rec).checkpoint(eager=True)
    n_logs, n_hours = (feats.agg(F.coalesce(F.sum("n_logs"), F.lit(0)), F.count(F.lit(1)))
                       .first())
    empty = feats.sparkSession.createDataFrame([], _ML_SCHEMA)
    if n_logs < K.IFOREST_MIN_LOGS or n_hours < K.IFOREST_MIN_HOURS:
        return empty
    s = isolation_scores(feats).where("is_outlier")
    score = F.abs(F.col("decision"))
    return s.select(
        F.col("hour").alias("timestamp"),
        F.lit("ML_DETECTED_ANOMALY").alias("anomaly_type"),
        F.when(score > 0.5, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.concat(F.lit("ML model detected anomalous log pattern (score: "), fmt(score, 3),
                 F.lit(")")).alias("description"),
        F.array().cast("array<string>").alias("affected_templates"),
        F.col("n_logs").cast("bigint").alias("log_count"),
        score.alias("score"),
        _details(ml_score=F.col("decision"),
                 features=F.to_json(F.struct(*[F.col(f).cast("double").alias(f) for f in FEATURES])))
        .alias("details"),
        F.col("decision").alias("ml_score"), *FEATURES)


_ML_SCHEMA = ("timestamp timestamp, anomaly_type string, severity string, description string, "
              "affected_templates array<string>, log_count bigint, score double, "
              "details map<string,string>, ml_score double, n_logs bigint, n_errors bigint, "
              "n_templates bigint, n_sources bigint, hour_of_day int, day_of_week int")


def forest_sql(features: str, n_trees: int = K.IFOREST_TREES, max_samples: int = K.IFOREST_MAX_SAMPLES,
               seed: int = K.IFOREST_SEED, contamination: float = K.IFOREST_CONTAMINATION) -> str:
    """The same forest in DuckDB SQL over the relation ``features`` (hour and
    FEATURES), as CTEs that end in ``scored`` (hour, FEATURES, anomaly_score,
    decision).  The depth limit is a number of the data, so levels are unrolled to
    that of ``max_samples`` and closed where ``psi`` says."""
    def u(*parts):
        text = " || '|' || ".join([f"'{seed}'", *parts])
        return f"(CAST('0x' || substr(md5({text}), 1, {DIGITS}) AS BIGINT) / {float(16 ** DIGITS)!r})"

    def c(n):
        return (f"(CASE WHEN {n} > 2 THEN 2.0::DOUBLE * (ln(CAST({n} AS DOUBLE) - 1) + {EULER_GAMMA!r}::DOUBLE) - "
                f"2.0::DOUBLE * (CAST({n} AS DOUBLE) - 1) / {n} WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")

    levels = _depth_limit(max_samples)
    xs = ", ".join(f"CAST({f} AS DOUBLE)" for f in FEATURES)
    ctes = [f"""fx AS (SELECT hour, [{xs}] AS x FROM {features}),
psi AS (SELECT least({max_samples}, count(*)) AS psi, CAST(ceil(log2(greatest(least({max_samples}, count(*)), 2))) AS INTEGER) AS lim FROM fx),
s0 AS (SELECT tree, x, CAST(1 AS BIGINT) AS node FROM (SELECT tree, x, row_number() OVER (PARTITION BY tree
    ORDER BY {u("'s'", "CAST(tree AS VARCHAR)", "CAST(CAST(epoch(hour) AS BIGINT) AS VARCHAR)")}, hour) AS r
  FROM fx, (SELECT unnest(generate_series(0, {n_trees - 1})) AS tree)), psi WHERE r <= psi)"""]
    parts = []
    for d in range(levels + 1):
        bounds = ", ".join(f"{{'f': {i}, 'lo': min(x[{i + 1}]), 'hi': max(x[{i + 1}])}}" for i in range(len(FEATURES)))
        ctes.append(f"""n{d} AS (SELECT tree, node, size, b.f AS feature, b.lo + {u("'t'", "CAST(tree AS VARCHAR)", "CAST(node AS VARCHAR)")} * (b.hi - b.lo) AS threshold, {d} AS depth
  FROM (SELECT tree, node, size, CASE WHEN size > 1 AND {d} < lim THEN usable[CAST(floor({u("'f'", "CAST(tree AS VARCHAR)", "CAST(node AS VARCHAR)")} * len(usable)) AS INTEGER) + 1] END AS b
    FROM (SELECT tree, node, count(*) AS size, list_filter([{bounds}], lambda b: b.hi > b.lo) AS usable FROM s{d} GROUP BY tree, node), psi)),
s{d + 1} AS (SELECT s.tree, s.x, 2 * s.node + (CASE WHEN s.x[n.feature + 1] < n.threshold THEN 0 ELSE 1 END) AS node
  FROM s{d} s JOIN n{d} n ON s.tree = n.tree AND s.node = n.node WHERE n.feature IS NOT NULL)""")
        parts.append(f"SELECT * FROM n{d}")
    ctes.append("forest AS (" + " UNION ALL ".join(parts) + ")")
    ctes.append(f"w0 AS (SELECT hour, x, tree, CAST(1 AS BIGINT) AS node, CAST(NULL AS BIGINT) AS done FROM fx, (SELECT unnest(generate_series(0, {n_trees - 1})) AS tree))")
    for d in range(levels + 1):
        ctes.append(f"""w{d + 1} AS (SELECT w.hour, w.x, w.tree, CASE WHEN n.feature IS NOT NULL THEN 2 * w.node + (CASE WHEN w.x[n.feature + 1] < n.threshold THEN 0 ELSE 1 END) END AS node,
    CASE WHEN w.node IS NOT NULL AND n.feature IS NULL THEN coalesce(CAST(round((n.depth + {c('n.size')}) * {UNIT}) AS BIGINT), {d * UNIT}) ELSE w.done END AS done
  FROM w{d} w LEFT JOIN forest n ON w.tree = n.tree AND w.node = n.node)""")
    ctes.append(f"""sc AS (SELECT hour, round(pow(2.0::DOUBLE, -(CAST(sum(done) AS BIGINT) / {float(UNIT)!r} / {float(n_trees)!r}) / {c('any_value(psi)')}), 12) AS anomaly_score
  FROM w{levels + 1}, psi GROUP BY hour),
scored AS (SELECT f.*, anomaly_score, round(-anomaly_score - (SELECT quantile_cont(-anomaly_score, {contamination}) FROM sc), 12) AS decision
  FROM {features} f JOIN sc ON f.hour = sc.hour)""")
    return ",\n".join(ctes)


__all__ = ["detect_ml", "isolation_scores", "grow", "path_lengths", "average_path_length", "forest_sql"]

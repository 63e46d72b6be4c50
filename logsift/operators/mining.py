"""Template mining (T1): one order-free rule over token counts, all ``groupBy``
and equi-joins.

Messages are masked and tokenised first (F9, F10).  The rule, for the distinct
messages of a table:

1. *Path.*  Token count and the first ``depth - 2`` tokens, a token with a digit
   as the wildcard.  Messages of different paths never share a template.
2. *Counts.*  How many distinct messages of the path have this token at this
   position.
3. *Anchors.*  Of the positions after the path's, a message keeps the tokens
   whose count is at least ``share`` times its largest one; the path's own
   tokens always count as kept.  The measure is the message's own, so a rare kind
   of message is not drowned by a frequent one of the same path.
4. *Similarity.*  Messages that keep less than ``sim`` of their tokens, wildcards
   not counted, are alike to none: they are their own group.
5. *Group* by path and anchors.  A position where all messages of a group agree
   is constant, the others are the wildcard.

The id is made from the group's earliest message (first arrival, then text), so
a template that widens keeps its id, and so does its ``first_seen``.  Nothing
depends on the number of messages, on the partitioning or, but for the id, on
the order; batches can be merged by their message statistics (``message_stats``,
``merge_message_stats``) and give what one batch gives.

Scale: log rows are aggregated to distinct messages before anything else, with
partial aggregation; exploded tokens carry a 16-byte message key, not the text.
No group is gathered: counts and agreements are sums, minima and maxima per
(path, position, token) and (group, position).  The only array is that of one
message's tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import configure, ensure_checkpoint_dir

PARAM = K.MASK_TOKEN
SHARE = 0.5
SEP = "\u0002"


def message_tokens(message: Column) -> Column:
    return F.when(message == "", F.array().cast("array<string>")).otherwise(F.split(message, " "))


def tree_path(tokens: Column, depth: int = K.DRAIN_DEPTH) -> Column:
    parts = [F.size(tokens).cast("string")]
    for i in range(max(depth - 2, 0)):
        t = F.get(tokens, i)
        parts.append(F.when(t.rlike(r"\d"), F.lit(PARAM)).otherwise(F.coalesce(t, F.lit(""))))
    return F.concat_ws(SEP, *parts)


def message_stats(logs: DataFrame, message: str = "template", seq: str = "ingest_seq") -> DataFrame:
    """One row per distinct message: rows, first_seq and, where the logs have
    times, first_seen and last_seen."""
    times = "timestamp" in logs.columns
    return (logs.where(F.col(message).isNotNull()).groupBy(F.col(message).alias("message"))
            .agg(F.count(F.lit(1)).alias("rows"), F.min(seq).alias("first_seq"),
                 *([F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")] if times else [])))


def merge_message_stats(*parts: DataFrame) -> DataFrame:
    """Statistics of several batches as those of one: counts add up, firsts are
    the least, lasts the greatest."""
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    least = [c for c in ("first_seq", "first_seen") if c in all_.columns]
    most = [c for c in ("last_seen",) if c in all_.columns]
    return all_.groupBy("message").agg(F.sum("rows").alias("rows"), *[F.min(c).alias(c) for c in least],
                                       *[F.max(c).alias(c) for c in most])


def mine_messages(stats: DataFrame, depth: int = K.DRAIN_DEPTH, sim: float = K.DRAIN_SIMILARITY,
                  share: float = SHARE) -> DataFrame:
    """``stats`` (message, rows, first_seq, ..: one row per message) -> its rows
    with mined_template_id, mined_template and cluster_size (rows of the
    template)."""
    configure(stats.sparkSession)
    ensure_checkpoint_dir(stats.sparkSession)
    prefix = max(depth - 2, 0)
    toks = message_tokens(F.col("message"))
    base = stats.withColumns({"toks": toks, "mid": F.md5("message"), "path": tree_path(toks, depth)})
    tokens = base.select("mid", "path", F.posexplode("toks").alias("pos", "token")).where(F.col("pos") >= prefix)
    counts = tokens.groupBy("path", "pos", "token").agg(F.count(F.lit(1)).alias("n"))
    seen = (tokens.join(counts, ["path", "pos", "token"]).groupBy("mid")
            .agg(F.max("n").alias("most"), F.collect_list(F.struct("pos", "n")).alias("ns")))
    kept = F.transform(F.array_sort(F.filter("ns", lambda x: x["n"] >= share * F.col("most"))), lambda x: x["pos"])
    own = base.join(seen, "mid", "left").withColumn("kept", F.coalesce(kept, F.array().cast("array<int>")))
    words = F.concat(
        F.filter(F.slice("toks", 1, prefix), lambda t: ~t.rlike(r"\d")) if prefix else F.array().cast("array<string>"),
        F.transform("kept", lambda p: F.get(F.col("toks"), p)))
    alone = F.size(F.filter(words, lambda t: t != PARAM)) < sim * F.size("toks")
    anchors = F.transform("kept", lambda p: F.concat(p.cast("string"), F.lit("="), F.get(F.col("toks"), p)))
    gid = F.md5(F.when(alone, F.concat(F.lit("m" + SEP), "message")).otherwise(
        F.concat_ws(SEP, F.lit("g"), "path", F.array_join(anchors, SEP))))
    # read three times below: the lineage is cut in the shared folder
    members = own.select(gid.alias("gid"), *stats.columns, "toks").checkpoint(eager=True)
    agree = (members.select("gid", F.posexplode("toks").alias("pos", "token")).groupBy("gid", "pos")
             .agg(F.min("token").alias("lo"), F.max("token").alias("hi")))
    text = F.transform(F.array_sort(F.collect_list(F.struct(
        "pos", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(PARAM)).alias("w")))), lambda x: x["w"])
    texts = agree.groupBy("gid").agg(F.array_join(text, " ").alias("text"))
    ids = members.groupBy("gid").agg(
        F.min(F.struct("first_seq", "message")).alias("first"), F.sum("rows").alias("cluster_size"))
    tid = F.concat(F.lit("tmpl_"), F.substring(F.md5("first.message"), 1, K.TEMPLATE_ID_HEX))
    groups = ids.join(texts, "gid", "left").select(
        "gid", tid.alias("mined_template_id"), F.coalesce("text", F.lit("")).alias("mined_template"), "cluster_size")
    return members.drop("toks").join(groups, "gid").drop("gid")


def mine_templates(messages: DataFrame, message: str = "template", seq: str = "ingest_seq",
                   depth: int = K.DRAIN_DEPTH, sim: float = K.DRAIN_SIMILARITY, share: float = SHARE) -> DataFrame:
    """Mapping from each distinct (masked, tokenised) message to its mined
    template: columns message, mined_template, mined_template_id, rows,
    cluster_size (rows of the whole template)."""
    return mine_messages(message_stats(messages, message, seq), depth, sim, share).select(
        "message", "mined_template", "mined_template_id", "rows", "cluster_size")


def assign_mined_templates(logs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mined template id, text and cluster size on every log row (an
    equi-join on the exact template text; AQE splits a hot key's partition)."""
    m = mapping.select(F.col("message").alias("template"), "mined_template_id", "mined_template",
                       "cluster_size")
    return logs.join(m, "template", "left")


def mined_stats(mined: DataFrame) -> DataFrame:
    """T5 from the output of ``mine_messages``, without the log rows: rows,
    distinct messages, first and last seen of each template."""
    return (mined.groupBy(F.col("mined_template_id").alias("template_id"))
            .agg(F.min("mined_template").alias("template"), F.sum("rows").alias("count"),
                 F.count(F.lit(1)).alias("n_messages"), F.min("first_seen").alias("first_seen"),
                 F.max("last_seen").alias("last_seen")))


def mining_sql(source: str, depth: int = K.DRAIN_DEPTH, sim: float = K.DRAIN_SIMILARITY, share: float = SHARE) -> str:
    """The same rule in DuckDB SQL over a relation ``source`` (template,
    ingest_seq, timestamp), as CTEs that end in ``mined`` (message, rows,
    first_seq, first_seen, last_seen, mined_template_id, mined_template,
    cluster_size)."""
    prefix = max(depth - 2, 0)
    path = " || chr(2) || ".join(["CAST(len(toks) AS VARCHAR)"] + [
        f"(CASE WHEN regexp_matches(toks[{i + 1}], '[0-9]') THEN '{PARAM}' ELSE coalesce(toks[{i + 1}], '') END)"
        for i in range(prefix)])
    return f"""m0 AS (SELECT template AS message, count(*) AS rows, min(ingest_seq) AS first_seq,
    min(timestamp) AS first_seen, max(timestamp) AS last_seen,
    CASE WHEN template = '' THEN []::VARCHAR[] ELSE string_split(template, ' ') END AS toks
  FROM {source} WHERE template IS NOT NULL GROUP BY template),
m1 AS (SELECT *, {path} AS path FROM m0),
tk AS (SELECT message, path, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM m1),
cn AS (SELECT path, pos, token, count(*) AS n FROM tk WHERE pos >= {prefix} GROUP BY ALL),
sn AS (SELECT message, pos, token, n, max(n) OVER (PARTITION BY message) AS most FROM tk JOIN cn USING (path, pos, token)),
an AS (SELECT message, count(*) FILTER (WHERE token <> '{PARAM}') AS n_kept,
    string_agg(CAST(pos AS VARCHAR) || '=' || token, chr(2) ORDER BY pos) AS anchors
  FROM sn WHERE n >= {share} * most GROUP BY message),
gr AS (SELECT m1.*, CASE WHEN coalesce(n_kept, 0) + len(list_filter(toks[1:{prefix}],
      lambda t: NOT regexp_matches(t, '[0-9]') AND t <> '{PARAM}')) < {sim} * len(toks)
    THEN 'm' || chr(2) || message ELSE 'g' || chr(2) || path || chr(2) || coalesce(anchors, '') END AS gid
  FROM m1 LEFT JOIN an USING (message)),
gt AS (SELECT gid, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM gr),
ga AS (SELECT gid, pos, CASE WHEN min(token) = max(token) THEN min(token) ELSE '{PARAM}' END AS w FROM gt GROUP BY gid, pos),
tx AS (SELECT gid, string_agg(w, ' ' ORDER BY pos) AS mined_template FROM ga GROUP BY gid),
gi AS (SELECT gid, 'tmpl_' || substr(md5(arg_min(message, first_seq)), 1, {K.TEMPLATE_ID_HEX}) AS mined_template_id,
    CAST(sum(rows) AS BIGINT) AS cluster_size FROM gr GROUP BY gid),
mined AS (SELECT message, rows, first_seq, first_seen, last_seen, mined_template_id,
    coalesce(mined_template, '') AS mined_template, cluster_size
  FROM gr JOIN gi USING (gid) LEFT JOIN tx USING (gid)),
mined_templates AS (SELECT mined_template_id AS template_id, min(mined_template) AS template,
    CAST(sum(rows) AS BIGINT) AS count, count(*) AS n_messages, min(first_seen) AS first_seen, max(last_seen) AS last_seen
  FROM mined GROUP BY 1)"""

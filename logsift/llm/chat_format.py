"""Chat formatting with a grammar round trip, in DataFrame functions only.

Template of a turn: ``<s>`` flag role ``[INST]`` text ``[/INST]</s>``, where
flag 1 says that the text is escaped (the role always is).  Control strings are
``<s> </s> [INST] [/INST]``; escaping puts one more ``~`` before their closing
bracket (``</s>`` to ``</s~>``, ``</s~>`` to ``</s~~>``), so it can be undone and leaves
no control string.

A conversation is rendered plainly, reparsed by the deterministic parser, and
the recovered turns are compared with the source.  The parser refuses a segment
with a control string inside, so conflicting content never comes back
identical; the turns that conflict are then escaped, and the result is parsed
and compared again (a difference raises an error).  The loss mask covers the
texts of assistant turns, as spans of the formatted string.

Turns are ordered by turn, then role, then text.  A conversation is one row by
contract, so its turns meet in one task.  Edge cases: null role and text are
empty; repeated rows are turns of their own; a null conv_id is one
conversation; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, table

ASSISTANT = "assistant"
CONTROL = r"</?s>|\[/?INST\]"
_BARE = r"(</?s|\[/?INST)(~*)([>\]])"
_STUFFED = r"(</?s|\[/?INST)~(~*)([>\]])"
_TURN = r"(?s)^<s>([01])(.*?)\[INST\](.*)\[/INST\]$"
PROBE = "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _BARE, "$1~$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _STUFFED, "$1$2$3")


def _render(turns: Column, escaped: bool) -> Column:
    def one(t):
        hit = t["text"].rlike(CONTROL) if escaped else F.lit(False)
        return F.concat(F.lit("<s>"), F.when(hit, "1").otherwise("0"), escape(t["role"]), F.lit("[INST]"),
                        F.when(hit, escape(t["text"])).otherwise(t["text"]), F.lit("[/INST]</s>"))
    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Turns (role, text, start, raw length, escaped) of a formatted string; null for a
    segment that the grammar refuses.  ``start`` counts within the segment."""
    segments = F.split(formatted, "</s>", -1)

    def one(seg):
        flag, role, text = (F.regexp_extract(seg, _TURN, i) for i in (1, 2, 3))
        good = seg.rlike(_TURN) & ~text.rlike(CONTROL) & ~role.rlike(CONTROL)
        return F.when(good, F.struct(
            unescape(role).alias("role"), F.when(flag == "1", unescape(text)).otherwise(text).alias("text"),
            (F.length(role) + 10).alias("start"), F.length(text).alias("chars"), F.length(seg).alias("size"),
            (flag == "1").alias("escaped")))

    return F.transform(F.slice(segments, 1, F.size(segments) - 1), one)


def _same(parsed: Column, turns: Column) -> Column:
    back = F.transform(parsed, lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text")))
    return back.eqNullSafe(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def _spans(parsed: Column) -> Column:
    """(start, end, escaped) of the assistant texts in the formatted string, in
    order: the loss mask."""
    zero = F.struct(F.lit(0).alias("at"), F.expr(
        "cast(array() as array<struct<start:int,end:int,escaped:boolean>>)").alias("spans"))

    def step(acc, p):
        start = acc["at"] + p["start"]
        span = F.array(F.struct(start.alias("start"), (start + p["chars"]).alias("end"), p["escaped"].alias("escaped")))
        return F.struct((acc["at"] + p["size"] + 4).alias("at"),
                        F.when(p["role"] == ASSISTANT, F.concat(acc["spans"], span))
                        .otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parsed, zero, step, lambda a: a["spans"])


def format_conversations(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) -> conv_id, formatted, turns (parsed
    back from ``formatted``), loss_spans."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("source"))
    plain = conv.withColumn("plain", _render(F.col("source"), False))
    tried = plain.withColumn("identical", _same(parse(F.col("plain")), F.col("source")))
    done = tried.withColumn("formatted", F.when(F.col("identical"), F.col("plain"))
                            .otherwise(_render(F.col("source"), True)))
    back = done.withColumn("turns", parse(F.col("formatted")))
    checked = F.when(_same(F.col("turns"), F.col("source")), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation does not survive the round trip")))
    return back.select("conv_id", checked.alias("formatted"), "turns").withColumn("loss_spans", _spans(F.col("turns")))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, cut out of the formatted string and unescaped."""
    def cut(s):
        text = F.substring(formatted, s["start"] + 1, s["end"] - s["start"])
        return F.when(s["escaped"], unescape(text)).otherwise(text)

    return F.array_join(F.transform(spans, cut), "")


def op6_chat_formatting(spark, sf_dir):
    prepare(spark)
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"),
                                  F.lit(PROBE).alias("text"))
    out = format_conversations(rows.union(probe))
    out = out.withColumn("loss", under_mask(F.col("formatted"), F.col("loss_spans")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                      F.sha2(digest, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(role, '(</?s|\[/?INST)(~*)([>\]])', '\1~\2\3', 'g') AS r,
  CASE WHEN regexp_matches(text, '</?s>|\[/?INST\]') THEN regexp_replace(text, '(</?s|\[/?INST)(~*)([>\]])', '\1~\2\3', 'g') ELSE text END AS t FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS a,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS l,
  sum(21 + length(r) + length(t)) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(a) AS turns_sha256, CAST(length(l) AS BIGINT) AS loss_chars,
  sha256(l) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""

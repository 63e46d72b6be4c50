"""Filtered log search (W1-W21): one DataFrame function with the request's
parameters as keyword arguments.

All set parameters are ANDed into a single ``where`` so Catalyst can push the
equality and range predicates into the parquet scan (and prune ``event_date``
partitions of a stored table).  The page is an ordered ``offset/limit``, which
plans as a top-k (``TakeOrderedAndProject``): each task keeps only
offset+limit rows, so no full sort and no single-task gather of the data.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRESETS = {"15m": dt.timedelta(minutes=15), "1h": dt.timedelta(hours=1),
           "6h": dt.timedelta(hours=6), "24h": dt.timedelta(hours=24),
           "7d": dt.timedelta(days=7), "30d": dt.timedelta(days=30)}
SORT_KEYS = ("timestamp", "level", "source", "file", "log_type")
RESPONSE_COLUMNS = ("log_id", "timestamp", "level", "message", "source", "log_type",
                    "template_id", "template", "network_info", "parsed_fields", "metadata",
                    "file_id", "filename")


@dataclass
class LogQuery:
    template_id: str | None = None
    start_time: dt.datetime | str | None = None
    end_time: dt.datetime | str | None = None
    level: str | None = None
    levels: tuple[str, ...] | None = None
    source: str | None = None
    message_contains: str | None = None
    file_id: str | None = None
    log_type: str | None = None
    has_network_info: bool | None = None
    protocol: str | None = None
    ip_address: str | None = None
    preset: str | None = None
    as_of: dt.datetime | str | None = None
    # Equality on parsed fields, e.g. {"status": "500", "method": "GET"}
    fields: dict[str, str] | None = None
    severity: str | None = None
    component: str | None = None
    user_id: str | None = None
    session_id: str | None = None
    status_code: str | None = None
    method: str | None = None
    user_agent: str | None = None
    sort_by: str = "timestamp"
    sort_desc: bool = True
    limit: int = 100
    offset: int = 0


# Where the offered filters look, the first key that a row has counts
NAMED_FIELDS = {
    "severity": ("severity",), "component": ("component", "program", "facility", "service"),
    "user_id": ("userId", "user_id", "user"), "session_id": ("sessionId", "session_id", "session"),
    "status_code": ("statusCode", "status_code", "status"), "method": ("method",),
    "user_agent": ("userAgent", "user_agent"),
}


def named_field(name: str) -> Column:
    return F.coalesce(*[F.col("parsed_fields")[k] for k in NAMED_FIELDS[name]])


def _ts(v) -> Column:
    return F.lit(v).cast("timestamp") if isinstance(v, str) else F.lit(v)


def predicate(q: LogQuery) -> Column:
    """The AND of every set parameter."""
    conds: list[Column] = []
    if q.template_id is not None:
        conds.append(F.col("template_id") == F.lit(str(q.template_id)))
    if q.start_time is not None:
        conds.append(F.col("timestamp") >= _ts(q.start_time))
        conds.append(F.col("event_date") >= F.to_date(_ts(q.start_time)))
    if q.end_time is not None:
        conds.append(F.col("timestamp") <= _ts(q.end_time))
        conds.append(F.col("event_date") <= F.to_date(_ts(q.end_time)))
    if q.preset is not None and q.preset != "custom":
        if q.as_of is None:
            raise ValueError("a preset range needs as_of")
        since = _ts(q.as_of) - F.make_interval(secs=F.lit(PRESETS[q.preset].total_seconds()))
        conds.append(F.col("timestamp") >= since)
        conds.append(F.col("event_date") >= F.to_date(since))
    if q.level:
        conds.append(F.col("level") == q.level)
    if q.levels:
        conds.append(F.col("level").isin(*q.levels))
    if q.source:
        conds.append(F.col("source").rlike("(?i)" + q.source))
    if q.message_contains:
        conds.append(F.col("message").rlike("(?i)" + q.message_contains))
    if q.file_id:
        conds.append(F.col("file_id") == q.file_id)
    if q.log_type:
        conds.append(F.col("log_type") == q.log_type)
    if q.has_network_info is True:
        conds.append(F.col("network_info").isNotNull())
    elif q.has_network_info is False:
        conds.append(F.col("network_info").isNull())
    if q.protocol:
        conds.append(F.array_contains(F.col("network_info.protocols"), q.protocol.upper()))
    if q.ip_address:
        ip = F.lit(q.ip_address)
        conds.append(F.array_contains(F.col("network_info.ip_addresses"), ip)
                     | (F.col("network_info.src_ip") == ip)
                     | (F.col("network_info.dst_ip") == ip))
    for key, value in (q.fields or {}).items():
        conds.append(F.col("parsed_fields")[key] == F.lit(str(value)))
    for name in NAMED_FIELDS:
        value = getattr(q, name)
        if value and name == "user_agent":      # part of the agent's text
            conds.append(F.lower(named_field(name)).contains(value.lower()))
        elif value:
            conds.append(F.lower(named_field(name)) == str(value).lower())
    # plain conjuncts (NULL counts as false in a filter), so that the simple
    # ones stay pushable to the scan
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def matching(logs: DataFrame, q: LogQuery) -> DataFrame:
    return logs.where(predicate(q))


def order_columns(q: LogQuery) -> list[Column]:
    """The chosen key, then log_id so ties are deterministic."""
    key = "filename" if q.sort_by == "file" else q.sort_by
    if key not in ("timestamp", "level", "source", "filename", "log_type"):
        raise ValueError(f"unknown sort key {q.sort_by}")
    k = F.col(key).desc_nulls_last() if q.sort_desc else F.col(key).asc_nulls_first()
    return [k, F.col("log_id").asc()]


def query_logs(logs: DataFrame, q: LogQuery) -> DataFrame:
    """One page of the matching rows, newest first by default."""
    page = matching(logs, q).orderBy(*order_columns(q))
    if q.offset:
        page = page.offset(q.offset)
    if q.limit:
        page = page.limit(q.limit)
    return page.select(*[c for c in RESPONSE_COLUMNS if c in logs.columns])


def respond(rows: DataFrame) -> DataFrame:
    """The response's columns, absent ones and nulls in fields, metadata and
    network facts as empty values."""
    empty = F.create_map().cast("map<string,string>")
    out = []
    for c in RESPONSE_COLUMNS:
        if c in ("parsed_fields", "metadata"):
            out.append((F.coalesce(c, empty) if c in rows.columns else empty).alias(c))
        elif c == "network_info":
            # an object with no key: what has no value is left out
            out.append((F.coalesce(F.to_json(c), F.lit("{}")) if c in rows.columns else F.lit("{}")).alias(c))
        else:
            out.append(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c))
    return rows.select(*out)


def date_counts(logs: DataFrame, q: LogQuery) -> DataFrame:
    """Matching rows per event date: the total (W16) and the skip table of deep
    pages in one aggregate."""
    return matching(logs, q).groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))


def deep_page(logs: DataFrame, q: LogQuery, counts: DataFrame | None = None) -> DataFrame:
    """The page at ``q.offset`` of rows ordered by time, reading only the
    dates it lies on.  ``counts`` are the ``date_counts`` of the same filter (one
    row per date, so their number is the span in days); equal to ``query_logs``."""
    if q.sort_by != "timestamp":
        raise ValueError("deep pages are by time; other orders have the cursor of next_page")
    table = sorted(((r["event_date"], r["n"]) for r in (counts if counts is not None else date_counts(logs, q)).collect()
                    if r["event_date"] is not None), reverse=q.sort_desc)
    before, wanted, skipped = 0, [], 0
    for date, n in table:
        if before + n > q.offset and before < q.offset + q.limit:
            wanted.append(date)
        elif before + n <= q.offset:
            skipped = before + n
        before += n
    rows = matching(logs, q).where(F.col("event_date").isin(wanted) if wanted else F.lit(False))
    return (rows.orderBy(*order_columns(q)).offset(q.offset - skipped).limit(q.limit)
            .select(*[c for c in RESPONSE_COLUMNS if c in logs.columns]))


def next_page(logs: DataFrame, q: LogQuery, cursor: tuple | None = None) -> DataFrame:
    """The ``q.limit`` rows behind ``cursor``, the (sort key, log_id) of the last
    row shown: a top-k of the rest, whatever the page's number."""
    rows = matching(logs, q)
    key = "filename" if q.sort_by == "file" else q.sort_by
    if cursor is not None:
        at, last = cursor
        at = _ts(at) if key == "timestamp" else F.lit(at)
        same = F.col(key).eqNullSafe(at) & (F.col("log_id") > F.lit(last))
        # nulls come last when descending, first when ascending
        beyond = (F.col(key) < at) | (F.col(key).isNull() & at.isNotNull()) if q.sort_desc else \
            (F.col(key) > at) | (at.isNull() & F.col(key).isNotNull())
        rows = rows.where(same | F.coalesce(beyond, F.lit(False)))
        if key == "timestamp":      # prunes the dates already shown
            day = F.to_date(at)
            rows = rows.where(F.col("event_date") <= day if q.sort_desc else F.col("event_date") >= day)
    return rows.orderBy(*order_columns(q)).limit(q.limit).select(*[c for c in RESPONSE_COLUMNS if c in logs.columns])


def total_count(logs: DataFrame, q: LogQuery) -> DataFrame:
    """Number of rows matching the same predicate (one row)."""
    return matching(logs, q).agg(F.count(F.lit(1)).alias("total_count"))


def client_page(page: DataFrame, page_number: int, page_size: int = 10,
                q: LogQuery | None = None) -> DataFrame:
    """The client shows ``page_size`` rows of the fetched page."""
    q = q or LogQuery()
    return (page.orderBy(*order_columns(q)).offset((page_number - 1) * page_size)
            .limit(page_size))


def recent(logs: DataFrame, as_of, minutes: int = 5, limit: int = 10) -> DataFrame:
    """Last ``minutes`` before ``as_of``, newest ``limit`` rows."""
    since = _ts(as_of) - F.make_interval(mins=F.lit(minutes))
    return (logs.where((F.col("timestamp") >= since) & (F.col("event_date") >= F.to_date(since)))
            .orderBy(F.col("timestamp").desc(), F.col("log_id").asc()).limit(limit))


TEMPLATE_SORTS = {"count": ("count", True), "template_id": ("template_id", False),
                  "first_seen": ("first_seen", False), "last_seen": ("last_seen", True)}


def search_templates(templates: DataFrame, text: str | None = None,
                     sort_by: str = "count") -> DataFrame:
    """Case-insensitive substring search over template text and id."""
    t = templates
    if text:
        needle = F.lower(F.lit(text))
        t = t.where(F.lower(F.col("template")).contains(needle)
                    | F.lower(F.col("template_id")).contains(needle))
    key, desc = TEMPLATE_SORTS[sort_by]
    return t.orderBy(F.col(key).desc() if desc else F.col(key).asc(), F.col("template_id").asc())


def find_files(files: DataFrame, file_id: str | None = None, text: str | None = None) -> DataFrame:
    """File lookup by id, or filename substring filter."""
    f = files
    if file_id:
        f = f.where(F.col("file_id") == file_id)
    if text:
        f = f.where(F.lower(F.col("original_filename")).contains(text.lower()))
    return f

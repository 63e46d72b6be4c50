"""Registered queries: name -> Spark builder ``(spark, sf_dir) -> DataFrame``
and, where the operator is SQL-expressible, the DuckDB oracle text.

Every query reads the driver's tables (``events``, ``documents``,
``conversations``) or tables Spark derives from them, over the whole table.
Result columns are text, bigint, double, boolean or timestamp; arrays are
joined with ',' so both engines print them the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from . import tables
from .oracle import with_logs

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        SPARK[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def _flat(spark, sf_dir):
    return tables.flat(tables.logs(spark, sf_dir))


def over(sql: str, ctes: str, name: str) -> str:
    """The oracle ``sql`` over logs_n, asked of the relation ``name`` that
    ``ctes`` derive from logs_n."""
    end = "FROM logs\n)"       # the end of logs_n
    head, _, rest = sql.partition(end)
    return f"{head}{end},\n{ctes}{rest.replace('logs_n', name)}"


# the incident that the detectors of the last hours are asked about (FIXTURES §4)
REPLAY_DAY = "2024-01-30"


def _replay(spark, sf_dir):
    return tables.replayed(tables.logs(spark, sf_dir), REPLAY_DAY)


def _on_replay(sql: str) -> str:
    return over(sql, tables.replayed_sql(REPLAY_DAY), "logs_r")


def _j(c: str) -> F.Column:
    return F.array_join(F.col(c), ",").alias(c)


def _dj(c: str) -> str:
    return f"array_to_string({c}, ',') AS {c}"


# ---------------------------------------------------------------- parsing --
_BASE = ["ingest_seq", "log_type", "timestamp", "level", "message", "source", "file_id",
         "filename", "template_id"]


@register("parse_all", with_logs(f"SELECT {', '.join(_BASE)} FROM logs_n"))
def parse_all(spark, sf_dir):
    return _flat(spark, sf_dir).select(*_BASE)


@register("classify_lines", with_logs(
    "SELECT log_type, count(*) AS n FROM logs_n GROUP BY log_type"))
def classify_lines(spark, sf_dir):
    return _flat(spark, sf_dir).groupBy("log_type").agg(F.count(F.lit(1)).alias("n"))


_FORMAT_COLS = {
    "parse_json": ("json", ["src_ip"]),
    "parse_syslog": ("syslog", ["syslog__hostname", "syslog__program", "syslog__pid",
                                "ip_address"]),
    "parse_apache": ("apache_access", ["apache_access__method", "apache_access__url",
                                       "apache_access__status", "apache_access__size",
                                       "apache_access__referer", "apache_access__user_agent",
                                       "src_ip", "protocol"]),
    "parse_firewall": ("firewall", ["firewall__action", "src_ip", "dst_ip", "src_port",
                                    "dst_port", "protocol"]),
    "parse_cisco": ("cisco_syslog", ["cisco_syslog__timezone", "cisco_syslog__facility",
                                     "cisco_syslog__severity", "cisco_syslog__mnemonic"]),
    "parse_windows": ("windows_event", ["windows_event__event_id", "windows_event__source"]),
    "parse_docker": ("docker", ["docker__container_id"]),
    "parse_unknown": ("unknown", []),
}


def _format_query(log_type: str, cols: list[str]):
    def build(spark, sf_dir):
        return (_flat(spark, sf_dir).where(F.col("log_type") == log_type)
                .select("ingest_seq", "timestamp", "level", "message", *cols))
    return build


for _name, (_lt, _cols) in _FORMAT_COLS.items():
    register(_name, with_logs(
        f"SELECT ingest_seq, timestamp, level, message{''.join(', ' + c for c in _cols)} "
        f"FROM logs_n WHERE log_type = '{_lt}'"))(_format_query(_lt, _cols))


@register("log_level_extract", with_logs(
    "SELECT level, log_type, count(*) AS n FROM logs_n GROUP BY level, log_type"))
def log_level_extract(spark, sf_dir):
    return (_flat(spark, sf_dir).groupBy("level", "log_type")
            .agg(F.count(F.lit(1)).alias("n")))


_NET = ["ip_addresses", "ports", "protocols", "mac_addresses"]


@register("network_facts", with_logs(
    "SELECT ingest_seq, " + ", ".join(_dj(c) for c in _NET) +
    ", src_ip, dst_ip, ip_address, src_port, dst_port, protocol, has_network_info FROM logs_n"))
def network_facts(spark, sf_dir):
    return _flat(spark, sf_dir).select(
        "ingest_seq", *[_j(c) for c in _NET], "src_ip", "dst_ip", "ip_address", "src_port",
        "dst_port", "protocol", "has_network_info")


@register("mask_messages", with_logs(
    "SELECT template_id, template, count(*) AS n FROM logs_n GROUP BY template_id, template"))
def mask_messages(spark, sf_dir):
    return (_flat(spark, sf_dir).groupBy("template_id", "template")
            .agg(F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------------ log search --
import hashlib  # noqa: E402

from ..operators import anomalies as D  # noqa: E402
from ..operators import query as Q  # noqa: E402
from ..operators import stats as S  # noqa: E402
from ..operators.templates import template_stats  # noqa: E402

AS_OF = "2024-01-31 00:00:00"
_PAGE_COLS = ["log_id", "timestamp", "level", "message", "source", "log_type", "template_id",
              "file_id", "filename"]
_ORDER = "ORDER BY timestamp DESC NULLS LAST, log_id ASC"


def _file_id(name: str) -> str:
    return hashlib.md5(name.encode()).hexdigest()[:16]


def _tmpl_id(text: str) -> str:
    return "tmpl_" + hashlib.md5(text.encode()).hexdigest()[:K.TEMPLATE_ID_HEX]


_SEARCHES = {
    # name: (LogQuery, DuckDB WHERE)
    "query_level": (Q.LogQuery(level="ERROR"), "level = 'ERROR'"),
    "query_time_range": (Q.LogQuery(start_time="2024-01-10 00:00:00", end_time="2024-01-10 06:00:00",
                                    limit=1000),
                         "timestamp BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-10 06:00:00'"),
    "query_source_regex": (Q.LogQuery(source="HOST-1[0-9]$"),
                           "regexp_matches(source, '(?i)HOST-1[0-9]$')"),
    "query_message_regex": (Q.LogQuery(message_contains="fail(ed)? for (click|view)"),
                            "regexp_matches(message, '(?i)fail(ed)? for (click|view)')"),
    "query_log_type": (Q.LogQuery(log_type="firewall", offset=50, limit=100),
                       "log_type = 'firewall'"),
    "query_protocol": (Q.LogQuery(protocol="tcp"), "list_contains(protocols, 'TCP')"),
    "query_ip": (Q.LogQuery(ip_address="10.0.1.8"),
                 "(list_contains(ip_addresses, '10.0.1.8') OR src_ip = '10.0.1.8' OR dst_ip = '10.0.1.8')"),
    "query_network_info": (Q.LogQuery(has_network_info=False), "NOT has_network_info"),
    "query_template": (Q.LogQuery(template_id=_tmpl_id("tcp connection failed for error")),
                       f"template_id = '{_tmpl_id('tcp connection failed for error')}'"),
    "query_file": (Q.LogQuery(file_id=_file_id("file-3.log"), level="INFO"),
                   f"file_id = '{_file_id('file-3.log')}' AND level = 'INFO'"),
    "query_fields": (Q.LogQuery(fields={"status": "500", "method": "GET"}),
                     "apache_access__status = '500' AND apache_access__method = 'GET'"),
    "query_page": (Q.LogQuery(levels=("ERROR", "WARN"), log_type="docker", preset="7d", as_of=AS_OF,
                              sort_by="level", sort_desc=False, offset=20, limit=50),
                   "level IN ('ERROR', 'WARN') AND log_type = 'docker' AND "
                   f"timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"),
}


def _search_query(lq: Q.LogQuery):
    def build(spark, sf_dir):
        return Q.query_logs(tables.logs(spark, sf_dir), lq).select(*_PAGE_COLS)
    return build


for _name, (_lq, _where) in _SEARCHES.items():
    _ord = ("ORDER BY level ASC NULLS FIRST, log_id ASC" if _lq.sort_by == "level" else _ORDER)
    register(_name, with_logs(
        f"SELECT {', '.join(_PAGE_COLS)} FROM logs_n WHERE {_where} {_ord} "
        f"LIMIT {_lq.limit} OFFSET {_lq.offset}"))(_search_query(_lq))


@register("query_text_indexed", with_logs(
    "SELECT log_id, message FROM logs_n WHERE regexp_matches(message, '(?i)took 1[0-9]*2 ms') "
    "OR regexp_matches(source, '(?i)took 1[0-9]*2 ms')"))
def query_text_indexed(spark, sf_dir):
    """A regular expression over the files that the trigram index names."""
    return tables.text_index(spark, sf_dir).search("took 1[0-9]*2 ms").select("log_id", "message")


@register("query_named_fields", with_logs(
    "SELECT log_id, log_type FROM logs_n WHERE (apache_access__method = 'GET' AND apache_access__status = '500') "
    "OR cisco_syslog__severity = '3' OR lower(coalesce(syslog__program, cisco_syslog__facility)) = 'error'"))
def query_named_fields(spark, sf_dir):
    """Status code and method, severity, component by their offered names."""
    logs = tables.logs(spark, sf_dir)
    found = [Q.matching(logs, q).select("log_id", "log_type") for q in (
        Q.LogQuery(status_code="500", method="get"), Q.LogQuery(severity="3"), Q.LogQuery(component="Error"))]
    return found[0].union(found[1]).union(found[2])


@register("query_response", with_logs(
    "SELECT log_id, coalesce(template, '') AS template, coalesce(src_ip, '') AS src_ip, has_network_info, "
    "CASE log_type WHEN 'syslog' THEN 4 WHEN 'apache_access' THEN 7 WHEN 'firewall' THEN 1 WHEN 'cisco_syslog' THEN 5 "
    "WHEN 'windows_event' THEN 3 WHEN 'docker' THEN 2 WHEN 'json' THEN 2 ELSE 0 END AS n_metadata, "
    "CASE log_type WHEN 'syslog' THEN 6 WHEN 'apache_access' THEN 10 WHEN 'firewall' THEN 7 WHEN 'cisco_syslog' THEN 7 "
    "WHEN 'windows_event' THEN 6 WHEN 'docker' THEN 5 WHEN 'json' THEN 5 ELSE 0 END AS n_fields FROM logs_n"))
def query_response(spark, sf_dir):
    """The response of every row, with its defaults."""
    out = Q.respond(tables.logs(spark, sf_dir))
    ni = F.from_json("network_info", "src_ip string")
    return out.select("log_id", F.coalesce("template", F.lit("")).alias("template"),
                      F.coalesce(ni["src_ip"], F.lit("")).alias("src_ip"), (F.col("network_info") != "{}").alias("has_network_info"),
                      F.size("metadata").alias("n_metadata"), F.size("parsed_fields").alias("n_fields"))


@register("query_deep_page", with_logs(
    f"SELECT {', '.join(_PAGE_COLS)} FROM logs_n WHERE log_type <> 'firewall' {_ORDER} LIMIT 50 OFFSET 4321"))
def query_deep_page(spark, sf_dir):
    """A page far behind, read from its dates alone."""
    logs = tables.logs(spark, sf_dir)
    rows = logs.where("log_type <> 'firewall'")
    return Q.deep_page(rows, Q.LogQuery(limit=50, offset=4321)).select(*_PAGE_COLS)


@register("query_cursor_page", with_logs(
    f"SELECT {', '.join(_PAGE_COLS)} FROM logs_n WHERE level = 'ERROR' {_ORDER} LIMIT 20 OFFSET 40"))
def query_cursor_page(spark, sf_dir):
    """The third page of 20, each from the last row of the one before."""
    logs, cursor = tables.logs(spark, sf_dir), None
    for _ in range(2):
        last = Q.next_page(logs, Q.LogQuery(level="ERROR", limit=20), cursor).collect()[-1]
        cursor = (last["timestamp"], last["log_id"])
    return Q.next_page(logs, Q.LogQuery(level="ERROR", limit=20), cursor).select(*_PAGE_COLS)


@register("query_total", with_logs(
    "SELECT count(*) AS total_count FROM logs_n WHERE level = 'ERROR' AND "
    "regexp_matches(source, '(?i)host-1')"))
def query_total(spark, sf_dir):
    return Q.total_count(tables.logs(spark, sf_dir), Q.LogQuery(level="ERROR", source="host-1"))


@register("feed_recent", _on_replay(with_logs(
    f"SELECT {', '.join(_PAGE_COLS)} FROM logs_n WHERE timestamp >= TIMESTAMP '{AS_OF}' - "
    f"INTERVAL 5 MINUTE {_ORDER} LIMIT 10")))
def feed_recent(spark, sf_dir):
    """W19/R3 batch form: last 5 minutes before as_of, newest 10, of the replayed day."""
    return Q.recent(_replay(spark, sf_dir), AS_OF, 5, 10).select(*_PAGE_COLS)


# ------------------------------------------------------------ statistics --
def _logs(spark, sf_dir):
    return tables.logs(spark, sf_dir)


@register("stats_totals", with_logs(
    "SELECT count(*) AS total_logs, count(DISTINCT template_id) AS total_templates, "
    "count(DISTINCT file_id) AS total_files FROM logs_n"))
def stats_totals(spark, sf_dir):
    return S.totals(_logs(spark, sf_dir))


def _count_by_sql(key, top=None, where=""):
    lim = f" LIMIT {top}" if top else ""
    return with_logs(f"SELECT {key}, count(*) AS count FROM logs_n {where} GROUP BY {key} "
                     f"ORDER BY count DESC, {key} ASC NULLS FIRST{lim}")


@register("stats_levels", _count_by_sql("level"))
def stats_levels(spark, sf_dir):
    return S.count_by(_logs(spark, sf_dir), "level")


@register("stats_sources_top10", _count_by_sql("source", 10))
def stats_sources_top10(spark, sf_dir):
    return S.count_by(_logs(spark, sf_dir), "source", 10)


@register("stats_types", _count_by_sql("log_type"))
def stats_types(spark, sf_dir):
    return S.count_by(_logs(spark, sf_dir), "log_type")


@register("stats_files_top10", _count_by_sql("filename", 10, "WHERE file_id IS NOT NULL"))
def stats_files_top10(spark, sf_dir):
    return S.top_files(_logs(spark, sf_dir), 10)


@register("stats_network", with_logs(
    "SELECT (SELECT count(*) FROM logs_n WHERE has_network_info) AS logs_with_network_info, "
    "(SELECT count(DISTINCT ip) FROM (SELECT unnest(ip_addresses) AS ip FROM logs_n)) AS unique_ips"))
def stats_network(spark, sf_dir):
    return S.network_summary(_logs(spark, sf_dir))


@register("stats_top_protocols", with_logs(
    "SELECT protocol, count(*) AS count FROM (SELECT unnest(protocols) AS protocol FROM logs_n) "
    "GROUP BY protocol ORDER BY count DESC, protocol ASC NULLS FIRST LIMIT 10"))
def stats_top_protocols(spark, sf_dir):
    return S.top_protocols(_logs(spark, sf_dir), 10)


@register("stats_hourly", with_logs(
    f"SELECT strftime(timestamp, '%Y-%m-%d %H:00') AS hour, count(*) AS count FROM logs_n "
    f"WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY 1"))
def stats_hourly(spark, sf_dir):
    return S.hourly_activity(_logs(spark, sf_dir), AS_OF, 24)


@register("file_level_dist", with_logs(
    "SELECT file_id, level, count(*) AS count FROM logs_n GROUP BY file_id, level"))
def file_level_dist(spark, sf_dir):
    return S.file_distribution(_logs(spark, sf_dir), "level")


@register("file_type_dist", with_logs(
    "SELECT file_id, log_type, count(*) AS count FROM logs_n GROUP BY file_id, log_type"))
def file_type_dist(spark, sf_dir):
    return S.file_distribution(_logs(spark, sf_dir), "log_type")


@register("file_network", with_logs(
    """SELECT n.file_id, n.logs_with_network_info, coalesce(p.unique_protocols, 0) AS unique_protocols,
              coalesce(i.unique_ips, 0) AS unique_ips
       FROM (SELECT file_id, count(*) AS logs_with_network_info FROM logs_n WHERE has_network_info GROUP BY file_id) n
       LEFT JOIN (SELECT file_id, count(DISTINCT v) AS unique_protocols FROM
                  (SELECT file_id, unnest(protocols) AS v FROM logs_n WHERE has_network_info) GROUP BY file_id) p
              ON n.file_id = p.file_id
       LEFT JOIN (SELECT file_id, count(DISTINCT v) AS unique_ips FROM
                  (SELECT file_id, unnest(ip_addresses) AS v FROM logs_n WHERE has_network_info) GROUP BY file_id) i
              ON n.file_id = i.file_id"""))
def file_network(spark, sf_dir):
    return S.file_network(_logs(spark, sf_dir))


@register("file_sources", with_logs(
    "SELECT file_id, source, count(*) AS count FROM logs_n GROUP BY file_id, source"))
def file_sources(spark, sf_dir):
    """Rows per source of each file."""
    return S.file_sources(_logs(spark, sf_dir))


@register("file_date_range", with_logs(
    "SELECT file_id, min(timestamp) AS earliest, max(timestamp) AS latest FROM logs_n GROUP BY file_id"))
def file_date_range(spark, sf_dir):
    return S.file_date_range(_logs(spark, sf_dir))


@register("file_error_rate", with_logs(
    """SELECT file_id, count(*) AS total_logs, count(*) FILTER (WHERE level = 'ERROR') AS error_count,
              count(*) FILTER (WHERE has_network_info) AS with_network_info,
              count(*) - count(*) FILTER (WHERE has_network_info) AS without_network_info,
              round(100.0 * count(*) FILTER (WHERE level = 'ERROR') / count(*), 2) AS error_rate,
              round(100.0 * count(*) FILTER (WHERE level = 'ERROR') / count(*), 2) > 5 AS error_alarm
       FROM logs_n GROUP BY file_id"""))
def file_error_rate(spark, sf_dir):
    return S.file_error_rate(_logs(spark, sf_dir))


@register("file_hour_of_day", with_logs(
    "SELECT file_id, lpad(CAST(hour(timestamp) AS VARCHAR), 2, '0') || ':00' AS hour, count(*) AS count "
    "FROM logs_n GROUP BY 1, 2"))
def file_hour_of_day(spark, sf_dir):
    return S.file_hour_of_day(_logs(spark, sf_dir))


@register("level_error_rate", with_logs(
    "SELECT round(100.0 * count(*) FILTER (WHERE level = 'ERROR') / count(*), 2) AS error_rate, "
    "round(100.0 * count(*) FILTER (WHERE level = 'ERROR') / count(*), 2) > 5 AS error_alarm FROM logs_n"))
def level_error_rate(spark, sf_dir):
    return S.error_rate_from_levels(S.count_by(_logs(spark, sf_dir), "level"))


_TEMPLATES_SQL = """templates AS (
  SELECT template_id, arg_min(template, ingest_seq) AS template, count(*) AS count,
         min(timestamp) AS first_seen, max(timestamp) AS last_seen
  FROM logs_n WHERE template_id IS NOT NULL GROUP BY template_id)"""


def _with_templates(select_sql: str) -> str:
    return with_logs(select_sql, _TEMPLATES_SQL)


@register("template_stats", _with_templates(
    "SELECT template_id, template, count, first_seen, last_seen FROM templates"))
def template_stats_q(spark, sf_dir):
    return template_stats(_logs(spark, sf_dir)).select(
        "template_id", "template", "count", "first_seen", "last_seen")


@register("template_top", _with_templates(
    "SELECT template_id, template, count FROM templates ORDER BY count DESC, template_id LIMIT 10"))
def template_top(spark, sf_dir):
    """The ten most frequent templates."""
    t = template_stats(_logs(spark, sf_dir))
    return Q.search_templates(t, None, "count").limit(10).select("template_id", "template", "count")


@register("template_search", _with_templates(
    "SELECT template_id, template, count, first_seen FROM templates "
    "WHERE contains(lower(template), 'connection') OR contains(lower(template_id), 'connection')"))
def template_search(spark, sf_dir):
    """Substring search over templates."""
    t = template_stats(_logs(spark, sf_dir))
    return Q.search_templates(t, "Connection", "first_seen").select(
        "template_id", "template", "count", "first_seen")


@register("template_summary", _with_templates(
    f"SELECT count(*) AS total_templates, count(*) FILTER (WHERE last_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) "
    "AS active_templates, 0 AS anomalous_templates, CAST(round(avg(count)) AS BIGINT) AS avg_count FROM templates"))
def template_summary(spark, sf_dir):
    return S.template_summary(template_stats(_logs(spark, sf_dir)), AS_OF)


@register("template_summary_anomalous", over(_with_templates(
    f"SELECT count(*) AS total_templates, count(*) FILTER (WHERE last_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) "
    "AS active_templates, count(*) FILTER (WHERE template_id IN (SELECT template_id FROM hits)) AS anomalous_templates, "
    "CAST(round(avg(count)) AS BIGINT) AS avg_count FROM templates").replace("templates AS (", f"""hits AS (
  SELECT template_id FROM (SELECT template_id, count(*) FILTER (WHERE timestamp < TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR) AS h,
    count(*) FILTER (WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR) AS r FROM logs_n
    WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1)
  WHERE h > 0 AND h <= (SELECT quantile_cont(h, 0.05) FROM (SELECT count(*) AS h FROM logs_n WHERE
      timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND timestamp < TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR GROUP BY template_id))
    AND r > 3 * (SELECT quantile_cont(h, 0.05) FROM (SELECT count(*) AS h FROM logs_n WHERE
      timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND timestamp < TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR GROUP BY template_id))),
templates AS (""", 1), tables.replayed_sql(REPLAY_DAY), "logs_r"))
def template_summary_anomalous(spark, sf_dir):
    """The summary with the templates that the rare-template detector found."""
    logs = _replay(spark, sf_dir)
    hits = D.detect_rare_templates(logs, AS_OF, 24, history_before=True)
    return S.template_summary(template_stats(logs), AS_OF, hits)


@register("template_timeline", with_logs(
    "SELECT template_id, CAST(timestamp AS DATE) AS date, count(*) AS count FROM logs_n "
    "GROUP BY 1, 2"))
def template_timeline(spark, sf_dir):
    """Rows per template per day."""
    return (_logs(spark, sf_dir).groupBy("template_id", F.to_date("timestamp").alias("date"))
            .agg(F.count(F.lit(1)).alias("count")))


# ------------------------------------------------------------- detectors --
_DETECT_COLS = ["timestamp", "anomaly_type", "severity", "description", "log_count", "score"]
_RECENT = "recent AS (SELECT * FROM logs_n WHERE timestamp >= TIMESTAMP '{as_of}' - INTERVAL {h} HOUR)"


def _volume_cte(hours: int) -> str:
    return _RECENT.format(as_of=AS_OF, h=hours) + """,
hourly AS (SELECT date_trunc('hour', timestamp) AS hour, count(*) AS n FROM recent GROUP BY 1),
cal AS (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM hourly),
series AS (SELECT cal.hour, coalesce(h.n, 0) AS n FROM cal LEFT JOIN hourly h ON cal.hour = h.hour),
s1 AS (SELECT hour, n, count(*) OVER () AS cnt, row_number() OVER (ORDER BY hour) AS rn,
              list(CAST(n AS DOUBLE)) OVER (ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS arr
       FROM series),
s2 AS (SELECT *, least(24, cnt - 1) AS w FROM s1),
s3 AS (SELECT *, list_slice(arr, len(arr) - w + 1, len(arr)) AS lastw FROM s2),
s4 AS (SELECT hour, n, cnt,
              CASE WHEN w >= 2 AND rn >= w THEN list_avg(lastw) END AS rolling_mean,
              CASE WHEN w >= 2 AND rn >= w THEN sqrt(list_sum(list_transform(lastw, lambda x: (x - list_avg(lastw)) * (x - list_avg(lastw)))) / (w - 1)) END AS rolling_std
       FROM s3),
s5 AS (SELECT *, (n - rolling_mean) / (rolling_std + 1e-6) AS z FROM s4)"""


def _volume_sql(hours: int) -> str:
    sel = """SELECT hour AS timestamp, CASE WHEN z > 0 THEN 'VOLUME_SPIKE' ELSE 'VOLUME_DROP' END AS anomaly_type,
       CASE WHEN abs(z) > 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       (CASE WHEN z > 0 THEN 'Unusual spike' ELSE 'Unusual drop' END) || ' in log volume: ' || CAST(n AS VARCHAR)
         || ' logs (z-score: ' || printf('%.2f', z) || ')' AS description,
       CAST(n AS BIGINT) AS log_count, abs(z) AS score, z AS z_score, rolling_mean, rolling_std
FROM s5 WHERE cnt >= 3 AND abs(z) > 3"""
    return with_logs(sel, _volume_cte(hours))


def _volume(hours, logs=_logs):
    def build(spark, sf_dir):
        return D.detect_volume(logs(spark, sf_dir), AS_OF, hours).select(
            *_DETECT_COLS, "z_score", "rolling_mean", "rolling_std")
    return build


# the last 24 h hold no anomaly of most kinds: the day of the replay does
register("anomaly_volume", _on_replay(_volume_sql(24)))(_volume(24, _replay))
register("anomaly_volume_30d", _volume_sql(24 * 31))(_volume(24 * 31))


@register("hourly_gapfill_rolling_z", with_logs(
    "SELECT hour, n, rolling_mean, rolling_std, z FROM s5", _volume_cte(24 * 31)))
def hourly_gapfill_rolling_z(spark, sf_dir):
    """N1-N3 over the 31 days before as_of: gap-filled hourly counts, trailing stats, z."""
    series = D.hourly_volume(D.recent_logs(_logs(spark, sf_dir), AS_OF, 24 * 31))
    return D.rolling_z(series).select("hour", "n", "rolling_mean", "rolling_std", "z")


@register("hourly_rolling_z_before", with_logs(
    "SELECT hour, n, rolling_mean, rolling_std, z FROM s5", _volume_cte(24 * 31)
    .replace("BETWEEN 23 PRECEDING AND CURRENT ROW", "BETWEEN 24 PRECEDING AND 1 PRECEDING")
    .replace("rn >= w", "rn > w")))
def hourly_rolling_z_before(spark, sf_dir):
    """The tested hour left out of its window (``exclude_current``)."""
    series = D.hourly_volume(D.recent_logs(_logs(spark, sf_dir), AS_OF, 24 * 31))
    return D.rolling_z(series, exclude_current=True).select("hour", "n", "rolling_mean", "rolling_std", "z")


def _error_rate_sql(hours: int) -> str:
    cte = _RECENT.format(as_of=AS_OF, h=hours) + """,
hl AS (SELECT date_trunc('hour', timestamp) AS hour, count(*) AS total,
              count(*) FILTER (WHERE level IN ('ERROR', 'CRITICAL', 'FATAL', 'WARN')) AS errors
       FROM recent GROUP BY 1),
r AS (SELECT *, errors / (total + 1e-6) AS rate, row_number() OVER (ORDER BY hour DESC) AS rn FROM hl),
b AS (SELECT *, coalesce(avg(CASE WHEN rn > 1 THEN rate END) OVER (), 0.0) AS baseline_rate FROM r)"""
    sel = """SELECT hour AS timestamp, 'HIGH_ERROR_RATE' AS anomaly_type,
       CASE WHEN rate > 0.5 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
       'High error rate detected: ' || printf('%.2f', rate * 100) || '% (' || CAST(errors AS VARCHAR)
         || ' errors out of ' || CAST(total AS VARCHAR) || ' logs)' AS description,
       CAST(total AS BIGINT) AS log_count, rate AS score, errors AS error_count, baseline_rate
FROM b WHERE rate > 0.1 AND rate > baseline_rate * 2"""
    return with_logs(sel, cte)


def _error_rate(hours, logs=_logs):
    def build(spark, sf_dir):
        return D.detect_error_rate(logs(spark, sf_dir), AS_OF, hours).select(
            *_DETECT_COLS, "error_count", "baseline_rate")
    return build


register("anomaly_error_rate", _on_replay(_error_rate_sql(24)))(_error_rate(24, _replay))
register("anomaly_error_rate_30d", _error_rate_sql(24 * 31))(_error_rate(24 * 31))


def _new_templates_sql(hours: int) -> str:
    cte = _TEMPLATES_SQL + ",\n" + _RECENT.format(as_of=AS_OF, h=hours) + f""",
seen AS (SELECT template_id, count(*) AS count FROM recent WHERE template_id IS NOT NULL GROUP BY 1),
t AS (SELECT s.template_id, s.count, h.first_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AS is_new
      FROM seen s LEFT JOIN templates h ON s.template_id = h.template_id),
a AS (SELECT count(*) AS total_templates, count(*) FILTER (WHERE is_new) AS new_templates,
             coalesce(sum(CASE WHEN is_new THEN count END), 0) AS new_rows FROM t),
r AS (SELECT *, new_templates / greatest(total_templates, 1) AS ratio FROM a)"""
    sel = f"""SELECT TIMESTAMP '{AS_OF}' AS timestamp, 'NEW_TEMPLATE_SURGE' AS anomaly_type,
       CASE WHEN ratio > 0.2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       'Unusual number of new log templates: ' || CAST(new_templates AS VARCHAR) || ' new templates ('
         || printf('%.1f', ratio * 100) || '% of total)' AS description,
       CAST(new_rows AS BIGINT) AS log_count, ratio AS score,
       new_templates AS new_template_count, total_templates AS total_template_count
FROM r WHERE ratio > 0.05"""
    return with_logs(sel, cte)


def _new_templates(hours):
    def build(spark, sf_dir):
        logs = _logs(spark, sf_dir)
        return D.detect_new_templates(logs, template_stats(logs), AS_OF, hours).select(
            *_DETECT_COLS, "new_template_count", "total_template_count")
    return build


@register("new_templates", with_logs(
    f"""SELECT s.template_id, t.template, s.count, t.first_seen,
              t.first_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AS is_new
       FROM seen s JOIN templates t ON s.template_id = t.template_id""",
    _TEMPLATES_SQL + ",\n" + _RECENT.format(as_of=AS_OF, h=24 * 31) + """,
seen AS (SELECT template_id, count(*) AS count FROM recent WHERE template_id IS NOT NULL GROUP BY 1)"""))
def new_templates_31d(spark, sf_dir):
    """D3 detail: the templates of the last 31 days, whether new, with count and first sighting."""
    logs = _logs(spark, sf_dir)
    return D.new_templates(logs, template_stats(logs), AS_OF, 24 * 31).select(
        "template_id", "template", "count", "first_seen", "is_new")


register("anomaly_new_templates", _new_templates_sql(24))(_new_templates(24))
register("anomaly_new_templates_7d", _new_templates_sql(24 * 7))(_new_templates(24 * 7))


def _rare_sql(hours: int, before: bool = False) -> str:
    end = f"AND timestamp < TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR" if before else ""
    cte = _RECENT.format(as_of=AS_OF, h=hours) + f""",
hist AS (SELECT template_id, count(*) AS hist_count FROM logs_n
         WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY {end} GROUP BY 1),
p5 AS (SELECT quantile_cont(hist_count, 0.05) AS rare_threshold FROM hist),
rare AS (SELECT hist.*, p5.rare_threshold FROM hist, p5 WHERE hist_count <= rare_threshold),
act AS (SELECT r.template_id, count(*) AS recent_count, arg_min(r.template, r.ingest_seq) AS template,
               any_value(rare.hist_count) AS historical_avg, any_value(rare.rare_threshold) AS rare_threshold
        FROM recent r JOIN rare ON r.template_id = rare.template_id
        WHERE r.timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR GROUP BY 1)"""
    sel = f"""SELECT TIMESTAMP '{AS_OF}' AS timestamp, 'RARE_TEMPLATE_ACTIVITY' AS anomaly_type,
       'MEDIUM' AS severity,
       'Unusual activity in rare template: ''' || substr(template, 1, 100) || '...'' ('
         || CAST(recent_count AS VARCHAR) || ' occurrences)' AS description,
       CAST(recent_count AS BIGINT) AS log_count, recent_count / rare_threshold AS score,
       template_id, recent_count, CAST(historical_avg AS DOUBLE) AS historical_avg, rare_threshold
FROM act WHERE recent_count > rare_threshold * 3"""
    return with_logs(sel, cte)


def _rare(hours, logs=_logs, before=False):
    def build(spark, sf_dir):
        return D.detect_rare_templates(logs(spark, sf_dir), AS_OF, hours, history_before=before).select(
            *_DETECT_COLS, "template_id", "recent_count", "historical_avg", "rare_threshold")
    return build


register("anomaly_rare_templates", _on_replay(_rare_sql(24, before=True)))(_rare(24, _replay, before=True))


def _silence_sql(hours: int) -> str:
    cte = _RECENT.format(as_of=AS_OF, h=hours) + """,
sh AS (SELECT source, date_trunc('hour', timestamp) AS hour, count(*) AS n FROM recent
       WHERE source IS NOT NULL GROUP BY 1, 2),
hrs AS (SELECT hour, row_number() OVER (ORDER BY hour DESC) AS hour_rank, count(*) OVER () AS n_hours
        FROM (SELECT DISTINCT hour FROM sh)),
per AS (SELECT source, sum(n) AS total, sum(CASE WHEN hour_rank <= 2 THEN n ELSE 0 END) AS recent_n,
               sum(CASE WHEN hour_rank > 2 THEN n ELSE 0 END) AS earlier, any_value(n_hours) AS n_hours
        FROM sh JOIN hrs USING (hour) GROUP BY source),
a AS (SELECT *, CASE WHEN n_hours > 2 THEN earlier / (n_hours - 2) ELSE 0.0 END AS historical_avg FROM per)"""
    sel = f"""SELECT TIMESTAMP '{AS_OF}' AS timestamp, 'SOURCE_SILENCE' AS anomaly_type, 'MEDIUM' AS severity,
       'Source ''' || source || ''' has gone silent (usually produces ' || printf('%.1f', historical_avg)
         || ' logs/hour)' AS description, CAST(0 AS BIGINT) AS log_count, historical_avg AS score,
       source, historical_avg
FROM a WHERE total >= 10 AND recent_n = 0 AND historical_avg > 5"""
    return with_logs(sel, cte)


def _silence(hours, logs=_logs):
    def build(spark, sf_dir):
        return D.detect_source_silence(logs(spark, sf_dir), AS_OF, hours).select(
            *_DETECT_COLS, "source", "historical_avg")
    return build


register("anomaly_source_silence", _on_replay(_silence_sql(24)))(_silence(24, _replay))


# --------------------------------------------------------------- rollups --
from ..operators import rollup as RU  # noqa: E402


@register("rollup_level_hours", with_logs(
    "SELECT date_trunc('hour', timestamp) AS hour, level, count(*) AS count FROM logs_n GROUP BY 1, 2"))
def rollup_level_hours(spark, sf_dir):
    """A2/A18 by hour, from the rollup alone."""
    return RU.level_counts(tables.rollup(spark, sf_dir), "hour")


@register("rollup_file_stats", with_logs(
    """SELECT file_id, count(*) AS total_logs, count(*) FILTER (WHERE level = 'ERROR') AS error_count, min(timestamp) AS earliest,
       max(timestamp) AS latest, round(100.0 * count(*) FILTER (WHERE level = 'ERROR') / count(*), 2) AS error_rate,
       true AS templates_close, true AS sources_close FROM logs_n GROUP BY file_id"""))
def rollup_file_stats(spark, sf_dir):
    """A8-A12 from the rollup; distinct counts within four standard errors of the exact ones."""
    exact = _logs(spark, sf_dir).groupBy("file_id").agg(F.countDistinct("template_id").alias("t"), F.countDistinct("source").alias("s"))
    out = RU.file_stats(tables.rollup(spark, sf_dir)).join(exact, "file_id")

    def close(a, b):
        return (F.abs(F.col(a) - F.col(b)) <= 0.0326 * F.col(b)).alias
    return out.select("file_id", "total_logs", "error_count", "earliest", "latest", "error_rate",
                      close("unique_templates", "t")("templates_close"), close("unique_sources", "s")("sources_close"))


@register("rollup_file_network", with_logs(
    """SELECT n.file_id, n.rows AS logs_with_network_info, true AS protocols_close, true AS ips_close
       FROM (SELECT file_id, count(*) AS rows FROM logs_n WHERE has_network_info GROUP BY file_id) n"""))
def rollup_file_network(spark, sf_dir):
    """A9 from the rollup; distinct counts within four standard errors of the exact ones."""
    exact = S.file_network(_logs(spark, sf_dir)).select("file_id", F.col("unique_protocols").alias("p"), F.col("unique_ips").alias("i"))
    out = RU.file_network(tables.rollup(spark, sf_dir)).join(exact, "file_id")
    return out.select("file_id", "logs_with_network_info",
                      (F.abs(F.col("unique_protocols") - F.col("p")) <= 0.0326 * F.col("p")).alias("protocols_close"),
                      (F.abs(F.col("unique_ips") - F.col("i")) <= 0.0326 * F.col("i")).alias("ips_close"))


@register("rollup_response_times", with_logs(
    r"""SELECT file_id, count(*) AS timed, sum(ms) / count(*) AS mean_ms, true AS p50_close, true AS p99_close
       FROM (SELECT file_id, TRY_CAST(regexp_extract(message, 'took (\d+) ms', 1) AS DOUBLE) AS ms FROM logs_n)
       WHERE ms IS NOT NULL GROUP BY file_id"""))
def rollup_response_times(spark, sf_dir):
    """C1 quantiles from the histogram, within a bin of the exact ones."""
    ms = F.regexp_extract("message", S.RESPONSE_TIME_RE, 1).try_cast("double")
    exact = _logs(spark, sf_dir).select("file_id", ms.alias("ms")).groupBy("file_id").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ms)").alias("m"),
        F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY ms)").alias("h"))
    out = RU.response_times(tables.latency(spark, sf_dir), "file_id").join(exact, "file_id")
    return out.select("file_id", "timed", "mean_ms", (F.abs(F.col("p50_ms") - F.col("m")) <= 0.01 * F.col("m")).alias("p50_close"),
                      (F.abs(F.col("p99_ms") - F.col("h")) <= 0.01 * F.col("h")).alias("p99_close"))


# ------------------------------------------------------- template mining --
from ..operators import mining as T  # noqa: E402

_MINED_COLS = "template_id, template, count, n_messages, first_seen, last_seen"


@register("templates_mined", with_logs(f"SELECT {_MINED_COLS} FROM mined_templates", T.mining_sql("logs_n")))
def templates_mined(spark, sf_dir):
    """Mined templates over all log rows with their statistics."""
    return T.mined_stats(tables.mined(spark, sf_dir))


@register("logs_mined", with_logs(
    "SELECT l.log_id, m.mined_template_id, m.mined_template, m.cluster_size FROM logs_n l "
    "LEFT JOIN mined m ON l.template = m.message", T.mining_sql("logs_n")))
def logs_mined(spark, sf_dir):
    """Mined id, text and cluster size on every log row."""
    return tables.mined_logs(spark, sf_dir).select(
        "log_id", F.col("template_id").alias("mined_template_id"), F.col("template").alias("mined_template"),
        "cluster_size")


# the queries below read the mined logs: rows of logs_n with mined ids and texts
_MINED_LOGS = T.mining_sql("logs_n") + """,
logs_m AS (SELECT l.* EXCLUDE (template_id, template), m.mined_template_id AS template_id, m.mined_template AS template,
    m.cluster_size FROM logs_n l LEFT JOIN mined m ON l.template = m.message)"""


def _on_mined(sql: str) -> str:
    """An oracle over logs_n, asked of the mined logs instead."""
    return over(sql, _MINED_LOGS, "logs_m")


def _mined(spark, sf_dir):
    return tables.mined_logs(spark, sf_dir)


@register("mined_template_top", _on_mined(ORACLE["template_top"]))
def mined_template_top(spark, sf_dir):
    """A13/T7 on mined templates."""
    t = T.mined_stats(tables.mined(spark, sf_dir))
    return Q.search_templates(t, None, "count").limit(10).select("template_id", "template", "count")


@register("mined_template_timeline", _on_mined(ORACLE["template_timeline"]))
def mined_template_timeline(spark, sf_dir):
    """T6 on mined templates."""
    return (_mined(spark, sf_dir).groupBy("template_id", F.to_date("timestamp").alias("date"))
            .agg(F.count(F.lit(1)).alias("count")))


@register("mined_new_templates", _on_mined(ORACLE["new_templates"]))
def mined_new_templates(spark, sf_dir):
    """D3 detail on mined templates, 31 days."""
    return D.new_templates(_mined(spark, sf_dir), T.mined_stats(tables.mined(spark, sf_dir)), AS_OF, 24 * 31).select(
        "template_id", "template", "count", "first_seen", "is_new")


@register("mined_anomaly_new_templates", _on_mined(_new_templates_sql(24 * 31)).replace(
    "SELECT count(*) AS total_templates,", "SELECT string_agg(template_id, ',' ORDER BY template_id) FILTER (WHERE is_new) "
    "AS affected_templates, count(*) AS total_templates,").replace(
    "SELECT TIMESTAMP", "SELECT coalesce(affected_templates, '') AS affected_templates, TIMESTAMP").replace(
    "WHERE ratio > 0.05", "WHERE ratio > -1"))
def mined_anomaly_new_templates(spark, sf_dir):
    """D3 on mined templates with the ids of the new ones, whatever their share."""
    return D.detect_new_templates(_mined(spark, sf_dir), T.mined_stats(tables.mined(spark, sf_dir)), AS_OF, 24 * 31,
                                  list_ids=True, threshold=-1.0).select(
        *_DETECT_COLS, "new_template_count", "total_template_count", _j("affected_templates"))


@register("mined_template_counts_7d", with_logs(
    f"SELECT template_id, count(*) AS count FROM logs_m "
    f"WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1", _MINED_LOGS))
def mined_template_counts_7d(spark, sf_dir):
    """A16 on mined templates."""
    since = F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    return (_mined(spark, sf_dir).where((F.col("timestamp") >= since) & (F.col("event_date") >= F.to_date(since)))
            .groupBy("template_id").agg(F.count(F.lit(1)).alias("count")))


# ------------------------------------------------------ ML detector, all --
from ..operators import iforest as IF  # noqa: E402


def _features_cte(hours: int, logs: str = "logs_n") -> str:
    return f"""recent AS (SELECT * FROM {logs} WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL {hours} HOUR),
feats AS (SELECT date_trunc('hour', timestamp) AS hour, count(level) AS n_logs,
                 CAST(sum(CASE WHEN level IN ('ERROR', 'CRITICAL', 'FATAL') THEN 1 ELSE 0 END) AS BIGINT) AS n_errors,
                 count(DISTINCT template_id) AS n_templates, count(DISTINCT source) AS n_sources
          FROM recent GROUP BY 1),
cal AS (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM feats),
features AS (SELECT c.hour, coalesce(n_logs, 0) AS n_logs, coalesce(n_errors, 0) AS n_errors,
              coalesce(n_templates, 0) AS n_templates, coalesce(n_sources, 0) AS n_sources,
              hour(c.hour) AS hour_of_day, isodow(c.hour) - 1 AS day_of_week
       FROM cal c LEFT JOIN feats f ON c.hour = f.hour)"""


def _ml_sql(hours: int, logs: str = "logs_n", before: str = "") -> str:
    cte = before + _features_cte(hours, logs) + ",\n" + IF.forest_sql("features")
    return with_logs(f"""SELECT hour AS timestamp, 'ML_DETECTED_ANOMALY' AS anomaly_type,
       CASE WHEN abs(decision) > 0.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       'ML model detected anomalous log pattern (score: ' || printf('%.3f', abs(decision)) || ')' AS description,
       n_logs AS log_count, abs(decision) AS score, decision AS ml_score, {', '.join(IF.FEATURES)}
FROM scored WHERE decision < 0 AND (SELECT sum(n_logs) >= {K.IFOREST_MIN_LOGS} AND count(*) >= {K.IFOREST_MIN_HOURS} FROM features)""", cte)


def _ml(hours, logs=_logs):
    def build(spark, sf_dir):
        return IF.detect_ml(logs(spark, sf_dir), AS_OF, hours).select(
            *_DETECT_COLS, "ml_score", *IF.FEATURES)
    return build


register("anomaly_ml", _ml_sql(24))(_ml(24))
register("anomaly_ml_30d", _ml_sql(24 * 31))(_ml(24 * 31))
register("mined_anomaly_ml_30d", _ml_sql(24 * 31, "logs_m", _MINED_LOGS + ",\n"))(_ml(24 * 31, _mined))


@register("hourly_features", with_logs("SELECT * FROM features", _features_cte(24 * 31)))
def hourly_features_q(spark, sf_dir):
    """A20 over the 31 days before as_of."""
    return S.hourly_features(D.recent_logs(_logs(spark, sf_dir), AS_OF, 24 * 31))


_ANOM_COLS = ["timestamp", "anomaly_type", "severity", "description", "log_count", "score"]


def _anomalies_all_sql(hours: int, ml: bool = False) -> str:
    cols = ", ".join(_ANOM_COLS)
    return "\nUNION ALL\n".join(
        f"SELECT {cols} FROM ({sql})" for sql in (
            _volume_sql(hours), _error_rate_sql(hours), _new_templates_sql(hours),
            _rare_sql(hours), _silence_sql(hours), *([_ml_sql(hours)] if ml else [])))


@register("anomalies_all", _anomalies_all_sql(24))
def anomalies_all(spark, sf_dir):
    """Every rule-based detector over the last 24 h, unioned in the
    anomaly layout (the ML detector is in anomalies_all_ml)."""
    logs = _logs(spark, sf_dir)
    out = D.run_detection(logs, template_stats(logs), AS_OF, 24, include_ml=False)
    return out.select(*_ANOM_COLS)


@register("anomalies_all_30d", _anomalies_all_sql(24 * 31))
def anomalies_all_30d(spark, sf_dir):
    """D7 over 31 days, rule-based detectors."""
    logs = _logs(spark, sf_dir)
    out = D.run_detection(logs, template_stats(logs), AS_OF, 24 * 31, include_ml=False)
    return out.select(*_ANOM_COLS)


@register("anomalies_all_ml", _anomalies_all_sql(24, ml=True))
def anomalies_all_ml(spark, sf_dir):
    """D7 with all six detectors."""
    logs = _logs(spark, sf_dir)
    out = D.run_detection(logs, template_stats(logs), AS_OF, 24, include_ml=True)
    return out.select(*_ANOM_COLS)


@register("anomalies_by_day")
def anomalies_by_day(spark, sf_dir):
    """Per day, log rows, anomalies (31-day rule-based run), top severity."""
    logs = _logs(spark, sf_dir)
    an = D.run_detection(logs, template_stats(logs), AS_OF, 24 * 31, include_ml=False)
    return D.anomalies_by_day(logs, an)


# ------------------------------------------------------ files and sources --
from ..sources import event_lines as EL  # noqa: E402
from ..sources import structured as ST  # noqa: E402
from ..sources import text_files as TF  # noqa: E402

_FILES_CTE = """flines AS (
  SELECT event_id, line, 'file-' || CAST(event_id % 11 AS VARCHAR) || '.log' AS original_filename,
         ts, regexp_replace(line, '^\\s+|\\s+$', '', 'g') = '' AS blank
  FROM raw_lines),
fb AS (SELECT original_filename, min(event_id) FILTER (WHERE NOT blank) AS first_pos,
              max(event_id) FILTER (WHERE NOT blank) AS last_pos FROM flines GROUP BY 1),
files AS (
  SELECT substr(md5(f.original_filename), 1, 16) AS file_id, f.original_filename,
         CAST(sum(strlen(line)) + count(*) - 1 AS BIGINT) AS file_size,
         max(ts) AS upload_timestamp,
         count(*) FILTER (WHERE NOT blank) AS processed_logs,
         CASE WHEN count(*) FILTER (WHERE NOT blank) = 0 THEN 1
              ELSE count(*) FILTER (WHERE blank AND event_id > first_pos AND event_id < last_pos) END
           AS failed_logs,
         'completed' AS status
  FROM flines f JOIN fb USING (original_filename) GROUP BY f.original_filename)"""


def _registry(spark, sf_dir):
    return TF.file_registry(EL.event_files(spark, sf_dir))


@register("file_ingest_counts", with_logs(
    "SELECT file_id, original_filename, file_size, upload_timestamp, processed_logs, failed_logs, "
    "status FROM files", _FILES_CTE))
def file_ingest_counts(spark, sf_dir):
    """The file registry of the fixture's files."""
    return _registry(spark, sf_dir).select(
        "file_id", "original_filename", "file_size", "upload_timestamp", "processed_logs",
        "failed_logs", "status")


@register("files_listing", with_logs(
    "SELECT file_id, original_filename, file_size, processed_logs, failed_logs, status FROM files "
    "ORDER BY upload_timestamp DESC, file_id", _FILES_CTE))
def files_listing(spark, sf_dir):
    """All uploads, newest first."""
    return TF.list_files(_registry(spark, sf_dir)).select(
        "file_id", "original_filename", "file_size", "processed_logs", "failed_logs", "status")


@register("files_summary", with_logs(
    "SELECT CAST(sum(file_size) AS BIGINT) AS total_size, CAST(sum(processed_logs) AS BIGINT) AS total_processed, "
    "CAST(sum(failed_logs) AS BIGINT) AS total_failed, count(*) AS total_files FROM files", _FILES_CTE))
def files_summary(spark, sf_dir):
    """Totals over the file registry."""
    return S.files_summary(_registry(spark, sf_dir))


_PRI_SPARK = ("'<' || cast(event_id % 192 AS varchar(20)) || '>' || date_format(ts,'MMM dd HH:mm:ss') "
              "|| ' host-' || cast(user_id % 20 AS varchar(20)) || ' ' || event_type || "
              "(CASE WHEN event_id % 2 = 0 THEN '[' || cast(user_id AS varchar(20)) || ']' ELSE '' END) "
              "|| ': ' || event_type || ' from user ' || cast(user_id AS varchar(20))")
_PRI_DUCK = _PRI_SPARK.replace("date_format(ts,'MMM dd HH:mm:ss')", "strftime(ts,'%b %d %H:%M:%S')")


def _pri_oracle() -> str:
    from .oracle import q as lit
    g = {name: f"regexp_extract(line, {lit(K.SYSLOG_PRI_RE)}, {i})"
         for i, name in enumerate(K.SYSLOG_PRI_GROUPS, 1)}
    sev = " ".join(f"WHEN {k} THEN '{v}'" for k, v in K.SEVERITY_LEVELS.items())
    return f"""WITH pl AS (SELECT event_id, {_PRI_DUCK} AS line FROM events),
p AS (SELECT event_id, {g['time']} AS time, {g['host']} AS host, {g['ident']} AS ident,
             nullif({g['pid']}, '') AS pid, {g['message']} AS message,
             CAST({g['pri']} AS INTEGER) AS pri FROM pl)
SELECT event_id, time, host, ident, pid, message, pri, CAST(pri // 8 AS INTEGER) AS facility,
       pri % 8 AS severity, CASE pri % 8 {sev} END AS level FROM p"""


@register("parse_syslog_pri", _pri_oracle())
def parse_syslog_pri_q(spark, sf_dir):
    """The collector's priority-syslog parser over lines derived from
    every event."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = ev.select("event_id", F.expr(_PRI_SPARK).alias("line"))
    return ST.parse_syslog_pri(lines).select(
        "event_id", "time", "host", "ident", "pid", "message", "pri", "facility", "severity", "level")


_COLLECTOR_TIME = ("CASE WHEN event_id % 5 = 0 THEN 'not a time' "
                   "ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") || 'Z' END")
_COLLECTOR_TIME_DUCK = ("CASE WHEN event_id % 5 = 0 THEN 'not a time' "
                        "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' END")


@register("collector_ingest", with_logs(
    f"""SELECT l.ingest_seq, coalesce(CAST(TRY_CAST(c.time AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP),
              TIMESTAMP '{AS_OF}') AS timestamp,
              coalesce(c.src, c.tag, 'fluent-bit') AS source, l.level, l.message, l.log_type
       FROM logs_n l JOIN (SELECT event_id, {_COLLECTOR_TIME_DUCK} AS time,
                                  CASE WHEN event_id % 3 = 0 THEN 'agent-' || CAST(user_id % 5 AS VARCHAR) END AS src,
                                  CASE WHEN event_id % 2 = 0 THEN 'file.' || event_type END AS tag
                           FROM events) c ON l.event_id = c.event_id"""))
def collector_ingest(spark, sf_dir):
    """S6/R1 batch form: collector records made from every event's line, with
    missing/bad times and sources, through the one parse path (Q15)."""
    lines = EL.raw_lines(spark, sf_dir)
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.expr(_COLLECTOR_TIME).alias("time"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN 'agent-' || CAST(user_id % 5 AS STRING) END").alias("source"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN 'file.' || event_type END").alias("tag"))
    recs = (lines.select("event_id", F.col("line").alias("log")).join(ev, "event_id")
            .withColumnRenamed("event_id", "ingest_seq"))
    entries = ST.collector_to_entries(recs, ingest_ts=F.lit(AS_OF).cast("timestamp"))
    logs = ST.entries_to_logs(entries, ingest_ts=F.lit(AS_OF).cast("timestamp"))
    return logs.select("ingest_seq", "timestamp", "source", "level", "message", "log_type")


@register("entry_ingest", with_logs(
    f"""SELECT ingest_seq, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-02-02 00:00:00' ELSE timestamp END AS timestamp,
       CASE WHEN event_id % 4 = 0 THEN 'NOTICE' ELSE level END AS level, message, source, log_type FROM logs_n"""))
def entry_ingest(spark, sf_dir):
    """Single entries from every event; given time and level win over the parsed ones."""
    lines = EL.raw_lines(spark, sf_dir)
    i = F.col("event_id")
    entries = lines.select(
        F.col("event_id").alias("ingest_seq"), F.col("line").alias("message"), "source",
        F.when(i % 3 == 0, F.lit("2024-02-02 00:00:00").cast("timestamp")).alias("timestamp"),
        F.when(i % 4 == 0, F.lit("NOTICE")).alias("level"), F.lit(None).cast("map<string,string>").alias("metadata"),
        "ingest_ts")
    return ST.entries_to_logs(entries, ingest_ts=F.col("ingest_ts")).select(
        "ingest_seq", "timestamp", "level", "message", "source", "log_type")


@register("json_log_filter", with_logs(
    """SELECT event_id, CASE WHEN j THEN json_extract_string(line, '$.message') END AS message,
       CASE WHEN j THEN coalesce(json_extract_string(line, '$.tag'), 'app') ELSE 'app' END AS tag,
       CASE WHEN j THEN json_extract_string(line, '$.src_ip') END AS src_ip, line AS log FROM t""",
    """t AS (SELECT event_id, CASE WHEN event_id % 16 = 5 THEN replace(line, '"k":', '"tag":') ELSE line END AS line,
       starts_with(stripped, '{') AND json_valid(line) AS j FROM l0)"""))
def json_log_filter(spark, sf_dir):
    """Records whose key ``log`` holds a JSON object get its fields, which win
    (some carry a tag of their own); the key stays."""
    line = F.when(F.col("event_id") % 16 == 5, F.replace("line", F.lit('"k":'), F.lit('"tag":'))).otherwise(F.col("line"))
    recs = EL.raw_lines(spark, sf_dir).select(
        "event_id", F.create_map(F.lit("log"), line, F.lit("tag"), F.lit("app")).alias("record"))
    r = F.col("record")
    return ST.json_log_filter(recs).select("event_id", *[r[k].alias(k) for k in ("message", "tag", "src_ip", "log")])


@register("container_times", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE "
          "date_trunc('second', ts) + to_milliseconds(event_id % 1000) END AS time FROM events")
def container_times(spark, sf_dir):
    """The container parser's time of every event (some are no times)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.when(F.col("event_id") % 5 == 0, "no time").otherwise(F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"),
        F.lit("456789Z")))
    return ev.select("event_id", ST.container_time(F.create_map(F.lit("time"), text)).alias("time"))


_AGENT_LINES = "raw_lines AS (SELECT event_id, ts, source, line || CASE WHEN event_id % 3 = 0 THEN ' \"-\" \"agent/' || CAST(event_id % 7 AS VARCHAR) || '\"' ELSE '' END AS line FROM (" + EL.raw_lines_sql("duckdb", "events") + "))"


@register("access_user_agents", with_logs(
    "SELECT ingest_seq, log_type, apache_access__user_agent IS NOT NULL AS has_user_agent, apache_access__user_agent AS user_agent "
    "FROM logs_n WHERE log_type = 'apache_access'", lines=_AGENT_LINES))
def access_user_agents(spark, sf_dir):
    """Access lines with and without an agent keep one label; the agent is a flag."""
    from ..operators.parse import parse_lines
    i = F.col("event_id")
    agent = F.when(i % 3 == 0, F.concat(F.lit(' "-" "agent/'), (i % 7).cast("string"), F.lit('"'))).otherwise("")
    parsed = parse_lines(EL.raw_lines(spark, sf_dir).withColumn("line", F.concat("line", agent)).drop("ts", "event_id"))
    ua = F.col("metadata")["user_agent"]
    return parsed.where("log_type = 'apache_access'").select("ingest_seq", "log_type", ua.isNotNull().alias("has_user_agent"),
                                                           ua.alias("user_agent"))


@register("parse_errors", "SELECT event_id, 'windows_event' AS log_type, d < 1 OR d > 31 AS parse_error, "
          "CASE WHEN d BETWEEN 1 AND 31 THEN TIMESTAMP '2024-01-01 10:00:00' + to_days(CAST(d - 1 AS INTEGER)) ELSE ts END AS timestamp "
          "FROM (SELECT event_id, ts, event_id % 40 AS d FROM events)")
def parse_errors(spark, sf_dir):
    """Lines whose time is none are flagged and keep the ingest time."""
    from ..operators.parse import parse_lines
    ev = EL.events(spark, sf_dir)
    line = F.concat(F.lit("2024-01-"), F.lpad((F.col("event_id") % 40).cast("string"), 2, "0"),
                    F.lit(" 10:00:00 INFO 4001 svc-x "), "event_type")
    lines = ev.select("event_id", line.alias("line"), F.col("ts").cast("timestamp").alias("ingest_ts"), F.lit("s").alias("source"))
    return parse_lines(lines).select("event_id", "log_type", "parse_error", "timestamp")


# ------------------------------------------------------------- streaming --
import uuid  # noqa: E402

from ..session import ensure_checkpoint_dir  # noqa: E402
from ..streaming import streams as R  # noqa: E402


def _run_stream_to_table(spark, sf_dir, make_agg):
    """Run a streaming aggregate over the stored logs table (the table's files
    as a file stream, one availableNow run) and return its result table."""
    path = tables.stored_logs_path(spark, sf_dir)
    batch = tables.logs(spark, sf_dir)
    stream = spark.readStream.schema(batch.schema).option("basePath", path).parquet(path)
    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logsift/stream-{uuid.uuid4().hex[:12]}"
    q = R.start_table_sink(make_agg(stream), f"{run}/out", f"{run}/ckpt", "complete",
                           {"availableNow": True})
    q.awaitTermination()
    return spark.read.parquet(f"{run}/out").drop("_batch")


def _run_stream_to_store(spark, sf_dir, start, batches: int = 3):
    """Run a sink over the stored logs table in about ``batches`` micro-batches and
    return the folder of what it keeps."""
    path = tables.stored_logs_path(spark, sf_dir)
    batch = tables.logs(spark, sf_dir)
    per = -(-len(batch.inputFiles()) // batches)
    stream = (spark.readStream.schema(batch.schema).option("basePath", path)
              .option("maxFilesPerTrigger", str(max(1, per))).parquet(path))
    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logsift/stream-{uuid.uuid4().hex[:12]}"
    start(stream, f"{run}/store", f"{run}/ckpt", {"availableNow": True}).awaitTermination()
    return f"{run}/store"


@register("stream_templates_merged", _with_templates(
    "SELECT template_id, template, count, first_seen, last_seen FROM templates"))
def stream_templates_merged(spark, sf_dir):
    """Template statistics merged from the deltas of several batches."""
    from ..operators.merge_table import MergeTable, merge_stats
    return MergeTable(spark, _run_stream_to_store(spark, sf_dir, R.start_merge_sink), merge_stats).read()


@register("stream_templates_mined", with_logs(f"SELECT {_MINED_COLS} FROM mined_templates", T.mining_sql("logs_n")))
def stream_templates_mined(spark, sf_dir):
    """T1/T3/T5 incrementally: templates mined batch by batch equal those of one batch."""
    from ..operators.merge_table import TemplateStore
    return TemplateStore(spark, _run_stream_to_store(spark, sf_dir, R.start_template_miner)).templates()


@register("stream_hourly_levels", with_logs(
    "SELECT date_trunc('hour', timestamp) AS hour, level, count(*) AS count FROM logs_n GROUP BY 1, 2"))
def stream_hourly_levels(spark, sf_dir):
    """Streaming one-hour tumbling counts per level (equal to batch)."""
    return _run_stream_to_table(spark, sf_dir, R.hourly_level_counts)


@register("stream_templates", with_logs(
    "SELECT template_id, count(*) AS count, min(timestamp) AS first_seen, max(timestamp) AS last_seen "
    "FROM logs_n GROUP BY 1"))
def stream_templates(spark, sf_dir):
    """Running template statistics as streaming state (equal to batch)."""
    return _run_stream_to_table(spark, sf_dir, R.running_template_stats)


# ------------------------------------------------------ dashboard series --
@register("perf_buckets", with_logs(
    """SELECT lpad(CAST(CAST(floor(hour(timestamp) / 4) * 4 AS INTEGER) AS VARCHAR), 2, '0') || ':00' AS time,
              round(avg(TRY_CAST(nullif(regexp_extract(message, 'took (\\d+) ms', 1), '') AS DOUBLE)), 6) AS response_time,
              count(*) AS throughput, count(*) FILTER (WHERE level = 'ERROR') AS errors
       FROM logs_n GROUP BY 1"""))
def perf_buckets(spark, sf_dir):
    """Response time, throughput and errors per 4-hour time-of-day bucket."""
    return S.performance_buckets(_logs(spark, sf_dir))


def _error_categories_sql() -> str:
    parts = []
    for name, words in K.ERROR_CATEGORIES:
        cond = " OR ".join(f"contains(lower(message), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{name}'")
    cat = f"CASE {' '.join(parts)} ELSE 'other' END"
    return with_logs(f"""SELECT category, count, round(100.0 * count / sum(count) OVER (), 2) AS percentage
FROM (SELECT {cat} AS category, count(*) AS count FROM logs_n WHERE level = 'ERROR' GROUP BY 1)""")


@register("error_categories", _error_categories_sql())
def error_categories(spark, sf_dir):
    """Error rows by keyword category with their share."""
    return S.error_categories(_logs(spark, sf_dir))


@register("metric_correlation", with_logs(
    """SELECT corr(n_logs, n_errors / n_logs) AS corr_volume_error_rate,
              corr(n_sources, n_errors / n_logs) AS corr_sources_error_rate
       FROM (SELECT date_trunc('hour', timestamp) AS hour, count(level) AS n_logs,
                    sum(CASE WHEN level IN ('ERROR', 'CRITICAL', 'FATAL') THEN 1 ELSE 0 END) AS n_errors,
                    count(DISTINCT source) AS n_sources FROM logs_n GROUP BY 1)"""))
def metric_correlation(spark, sf_dir):
    """Correlation of hourly volume / sources with the hourly error rate."""
    return S.metric_correlation(S.hourly_features(_logs(spark, sf_dir)))


@register("error_trend", with_logs(
    """SELECT CAST(timestamp AS DATE) AS date, count(*) AS total,
              count(*) FILTER (WHERE level = 'ERROR') AS errors,
              round(100.0 * count(*) FILTER (WHERE level = 'ERROR') / count(*), 2) AS error_rate
       FROM logs_n GROUP BY 1"""))
def error_trend(spark, sf_dir):
    """C4: errors and error rate per day."""
    return S.error_trend(_logs(spark, sf_dir))


@register("level_share", with_logs(
    "SELECT level, count, round(100.0 * count / sum(count) OVER (), 2) AS percentage "
    "FROM (SELECT level, count(*) AS count FROM logs_n GROUP BY 1)"))
def level_share(spark, sf_dir):
    """Rows per level with their share."""
    return S.level_share(_logs(spark, sf_dir))


@register("network_split", with_logs(
    "SELECT count(*) FILTER (WHERE has_network_info) AS with_network_info, "
    "count(*) FILTER (WHERE NOT has_network_info) AS without_network_info FROM logs_n"))
def network_split(spark, sf_dir):
    """Rows with and without network facts."""
    return S.network_split(_logs(spark, sf_dir))


def _growth(c: str) -> str:
    return (f"round(100.0 * ({c} - lag({c}) OVER (ORDER BY date)) / lag({c}) OVER (ORDER BY date), 6) "
            f"AS {c}_growth")


@register("period_growth", with_logs(
    f"""SELECT date, logs, templates, files, round(error_rate, 6) AS error_rate,
              {_growth('logs')}, {_growth('templates')}, {_growth('files')}, {_growth('error_rate')}
       FROM (SELECT CAST(timestamp AS DATE) AS date, count(*) AS logs,
                    count(DISTINCT template_id) AS templates, count(DISTINCT file_id) AS files,
                    100.0 * count(*) FILTER (WHERE level = 'ERROR') / count(*) AS error_rate
             FROM logs_n GROUP BY 1)"""))
def period_growth(spark, sf_dir):
    """Day-over-day growth of logs, templates, files and error rate."""
    return S.period_growth(_logs(spark, sf_dir))


@register("template_trend", with_logs(
    f"""SELECT template_id, days, round(slope, 6) AS slope,
              CASE WHEN slope > {S.TREND_BAND} THEN 'increasing'
                   WHEN slope < -{S.TREND_BAND} THEN 'decreasing' ELSE 'stable' END AS trend
       FROM (SELECT template_id, count(*) AS days,
                    CASE WHEN count(*) >= 2 THEN regr_slope(n, d) END AS slope
       FROM (SELECT template_id, CAST(CAST(timestamp AS DATE) - DATE '1970-01-01' AS DOUBLE) AS d,
                    CAST(count(*) AS DOUBLE) AS n FROM logs_n GROUP BY template_id, CAST(timestamp AS DATE))
       GROUP BY template_id)"""))
def template_trend(spark, sf_dir):
    """Per template slope of daily counts, banded into a trend."""
    return S.template_trend(_logs(spark, sf_dir))


def _by_day_sql() -> str:
    an = _anomalies_all_sql(24 * 31)
    return with_logs(f"""SELECT coalesce(n.date, a.date) AS date, coalesce(n.normal, 0) AS normal,
       coalesce(a.anomalies, 0) AS anomalies,
       CASE a.sev WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END AS severity
FROM (SELECT CAST(timestamp AS DATE) AS date, count(*) AS normal FROM logs_n GROUP BY 1) n
FULL OUTER JOIN (SELECT CAST(timestamp AS DATE) AS date, count(*) AS anomalies,
                        max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS sev
                 FROM ({an}) GROUP BY 1) a ON n.date = a.date""")


ORACLE["anomalies_by_day"] = _by_day_sql()


# ------------------------------------------- whole texts of other tables --
from ..functions import network as NW  # noqa: E402
from ..functions import text as TX  # noqa: E402
from .oracle import _mask_sql, _ports_sql, _protocols_sql  # noqa: E402


@register("mask_documents", f"""SELECT doc_id, n_chars, len(toks) AS n_tokens,
       len(list_filter(toks, lambda t: t = '<*>')) AS n_masks, md5(array_to_string(toks, ' ')) AS masked_md5
FROM (SELECT doc_id, n_chars, CASE WHEN m = '' THEN []::VARCHAR[] ELSE string_split(m, ' ') END AS toks
      FROM (SELECT doc_id, n_chars, {_mask_sql('text')} AS m FROM documents))""")
def mask_documents(spark, sf_dir):
    """F9/F10 over whole documents: tokens, masks, digest of the masked text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toks = TX.tokens(TX.mask(F.col("text")))
    return docs.select("doc_id", "n_chars", toks.alias("t")).select(
        "doc_id", "n_chars", F.size("t").alias("n_tokens"),
        F.size(F.filter("t", lambda x: x == K.MASK_TOKEN)).alias("n_masks"),
        F.md5(F.array_join("t", " ")).alias("masked_md5"))


@register("document_network", f"""SELECT doc_id,
       array_to_string(regexp_extract_all(text, '{K.IP_RE}', 1), ',') AS ip_addresses,
       array_to_string({_ports_sql('text')}, ',') AS ports,
       array_to_string({_protocols_sql('text')}, ',') AS protocols,
       array_to_string(regexp_extract_all(text, '{K.MAC_RE}', 1), ',') AS mac_addresses
FROM documents""")
def document_network(spark, sf_dir):
    """F1-F5 over whole documents (empty lists as '')."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = F.col("text")
    empty = F.lit("")
    return docs.select(
        "doc_id",
        F.coalesce(F.array_join(NW.ip_addresses(t), ","), empty).alias("ip_addresses"),
        F.coalesce(F.array_join(NW.ports(t), ","), empty).alias("ports"),
        F.coalesce(F.array_join(NW.protocols(t), ","), empty).alias("protocols"),
        F.coalesce(F.array_join(NW.mac_addresses(t), ","), empty).alias("mac_addresses"))


@register("display_fields", with_logs(
    """SELECT log_id, lpad(CAST(hour(timestamp) AS VARCHAR), 2, '0') || ':00' AS hour_label,
              CASE WHEN length(message) > 50 THEN substr(message, 1, 50) || '...' ELSE message END AS short_message,
              CASE WHEN TRY_CAST(apache_access__status AS INTEGER) >= 400 THEN 'destructive'
                   WHEN TRY_CAST(apache_access__status AS INTEGER) >= 300 THEN 'secondary'
                   ELSE 'default' END AS status_class
       FROM logs_n WHERE log_type = 'apache_access'"""))
def display_fields(spark, sf_dir):
    """F15/F17/F18 on access-log rows: hour label, cut message, status class."""
    f = _flat(spark, sf_dir).where(F.col("log_type") == "apache_access")
    return f.select("log_id", TX.hour_label(F.col("timestamp")).alias("hour_label"),
                    TX.truncate_text(F.col("message"), 50).alias("short_message"),
                    TX.status_class(F.col("apache_access__status")).alias("status_class"))


@register("file_sizes_readable", with_logs(
    """SELECT file_id, CASE WHEN file_size = 0 THEN '0 Bytes' ELSE
              regexp_replace(CAST(round(file_size / pow(1024, i), 2) AS VARCHAR), '\\.0$', '') || ' ' ||
              (['Bytes', 'KB', 'MB', 'GB'])[i + 1] END AS size_text
       FROM (SELECT file_id, file_size, CAST(floor(ln(file_size) / ln(1024)) AS INTEGER) AS i FROM files)""",
    _FILES_CTE))
def file_sizes_readable(spark, sf_dir):
    """F16: file sizes as text, base 1024, two decimals."""
    return _registry(spark, sf_dir).select("file_id", TX.readable_size(F.col("file_size")).alias("size_text"))


_CONVERSATION_LINES = f"""raw_lines AS (
  SELECT (CAST(conv_id AS BIGINT) << 36) + (CAST(turn AS BIGINT) << 20) + generate_subscripts(t, 1) - 1 AS event_id,
         TIMESTAMP '{AS_OF}' AS ts, role AS source, unnest(t) AS line
  FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS t FROM conversations WHERE text IS NOT NULL))"""


@register("templates_mined_conversations", with_logs(
    f"SELECT {_MINED_COLS} FROM mined_templates", T.mining_sql("logs_n"), _CONVERSATION_LINES))
def templates_mined_conversations(spark, sf_dir):
    """T1 over every line of every conversation turn."""
    from ..operators.parse import parse_lines
    from ..operators.templates import assign_exact_templates
    src = f"{sf_dir}/conversations.parquet"

    def build():
        conv = spark.read.parquet(src)
        lines = conv.select(F.posexplode(F.split("text", "\n")).alias("pos", "line"), "conv_id",
                            "turn", F.col("role").alias("source"))
        lines = lines.select("line", "source", F.lit(AS_OF).cast("timestamp").alias("ingest_ts"),
                             # one long: 2^27 conversations of 2^16 turns of 2^20 lines
                             (F.shiftleft(F.col("conv_id").cast("long"), 36)
                              + F.shiftleft(F.col("turn").cast("long"), 20) + F.col("pos")).alias("ingest_seq"))
        return assign_exact_templates(parse_lines(tables.spread(lines)))

    logs = tables.stored(spark, "conversation-logs", [src], build)
    return T.mined_stats(T.mine_messages(T.message_stats(logs)))


# ------------------------------------------- merges, joins, feed, report --
from ..operators.templates import merge_template_stats  # noqa: E402
from ..sources import sinks as SK  # noqa: E402

_SPLIT = "2024-01-15 00:00:00"


@register("template_stats_merged", _with_templates(
    "SELECT template_id, template, count, first_seen, last_seen FROM templates"))
def template_stats_merged(spark, sf_dir):
    """Statistics of two time slices merged by union + re-aggregate equal
    the statistics of the whole table."""
    logs = _logs(spark, sf_dir)
    early = template_stats(logs.where(F.col("timestamp") < F.lit(_SPLIT).cast("timestamp")))
    late = template_stats(logs.where(F.col("timestamp") >= F.lit(_SPLIT).cast("timestamp")))
    return merge_template_stats(early, late).select(
        "template_id", "template", "count", "first_seen", "last_seen")


@register("query_client_page", with_logs(
    f"SELECT {', '.join(_PAGE_COLS)} FROM logs_n WHERE level = 'ERROR' {_ORDER} LIMIT 10 OFFSET 20"))
def query_client_page(spark, sf_dir):
    """The third client page (10 rows) of the first server page."""
    lq = Q.LogQuery(level="ERROR")
    page = Q.query_logs(tables.logs(spark, sf_dir), lq)
    return Q.client_page(page, 3, 10, lq).select(*_PAGE_COLS)


@register("files_lookup", with_logs(
    "SELECT file_id, original_filename, processed_logs FROM files "
    "WHERE contains(lower(original_filename), 'file-1')", _FILES_CTE))
def files_lookup(spark, sf_dir):
    """File list filtered by a name substring."""
    return Q.find_files(_registry(spark, sf_dir), text="FILE-1").select(
        "file_id", "original_filename", "processed_logs")


_FEED_NEW = f"timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR"
_FEED_SHOWN = (f"timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 3 HOUR AND "
               f"timestamp < TIMESTAMP '{AS_OF}' - INTERVAL 90 MINUTE")


@register("feed_merge", with_logs(
    f"""SELECT log_id, timestamp, level, message FROM (
          SELECT DISTINCT log_id, timestamp, level, message FROM logs_n WHERE {_FEED_NEW}
          UNION SELECT DISTINCT log_id, timestamp, level, message FROM logs_n WHERE {_FEED_SHOWN})
        ORDER BY timestamp DESC, log_id LIMIT 20"""))
def feed_merge(spark, sf_dir):
    """New rows merged with the rows already shown, newest 20 kept."""
    logs = tables.logs(spark, sf_dir)
    cols = ["log_id", "timestamp", "level", "message"]
    new = logs.where(F.expr(_FEED_NEW)).select(*cols)
    shown = logs.where(F.expr(_FEED_SHOWN)).select(*cols)
    return (new.unionByName(shown).dropDuplicates(["log_id"])
            .orderBy(F.col("timestamp").desc(), "log_id").limit(20))


@register("feed_new_rows", with_logs(
    f"""SELECT log_id, timestamp FROM logs_n n WHERE {_FEED_NEW.replace('timestamp', 'n.timestamp')}
        AND NOT EXISTS (SELECT 1 FROM logs_n s WHERE s.log_id = n.log_id AND
                        {_FEED_SHOWN.replace('timestamp', 's.timestamp')})"""))
def feed_new_rows(spark, sf_dir):
    """Rows of the newest window that were not shown before (anti join)."""
    logs = tables.logs(spark, sf_dir)
    new = logs.where(F.expr(_FEED_NEW)).select("log_id", "timestamp")
    shown = logs.where(F.expr(_FEED_SHOWN)).select("log_id")
    return new.join(shown, "log_id", "left_anti")


@register("logs_with_files", with_logs(
    "SELECT l.log_id, l.template_id, f.original_filename, f.status, t.count AS template_count "
    "FROM logs_n l LEFT JOIN files f ON l.file_id = f.file_id "
    "LEFT JOIN templates t ON l.template_id = t.template_id",
    _FILES_CTE + ",\n" + _TEMPLATES_SQL))
def logs_with_files(spark, sf_dir):
    """Every log row with its file's registry row and its template's
    count.  The right sides are aggregates (one row per file / template);
    AQE broadcasts them when their measured size is small, else it joins by
    shuffle and splits a hot key's partition."""
    logs = tables.logs(spark, sf_dir)
    files = _registry(spark, sf_dir).select("file_id", "original_filename", "status")
    tmpl = template_stats(logs).select("template_id", F.col("count").alias("template_count"))
    return (logs.select("log_id", "template_id", "file_id").join(files, "file_id", "left")
            .join(tmpl, "template_id", "left")
            .select("log_id", "template_id", "original_filename", "status", "template_count"))


@register("anomalies_recent", f"SELECT * FROM ({_anomalies_all_sql(24 * 31)}) WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 600 HOUR")
def anomalies_recent(spark, sf_dir):
    """Anomalies of the last 25 days out of the 31-day run."""
    logs = _logs(spark, sf_dir)
    an = D.run_detection(logs, template_stats(logs), AS_OF, 24 * 31, include_ml=False)
    return D.recent_anomalies(an, AS_OF, 600).select(*_ANOM_COLS)


@register("anomaly_report", f"""SELECT strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp,
       anomaly_type AS type, severity, description, score
FROM ({_anomalies_all_sql(24 * 31)})""")
def anomaly_report(spark, sf_dir):
    """Report rows of the 31-day rule-based run (severity order)."""
    logs = _logs(spark, sf_dir)
    an = D.run_detection(logs, template_stats(logs), AS_OF, 24 * 31, include_ml=False)
    return SK.anomaly_report(D.report_order(an)).drop("details")


def _detail_sql(sql: str, **details) -> str:
    rows = " UNION ALL ".join(
        f"SELECT timestamp, anomaly_type AS type, '{k}' AS key, CAST({v} AS DOUBLE) AS number FROM found"
        for k, v in details.items())
    return f"WITH found AS ({sql}) {rows}"


@register("anomaly_report_details", " UNION ALL ".join(f"SELECT * FROM ({q})" for q in (
    _detail_sql(_volume_sql(24 * 31), z_score="z_score", actual_count="log_count"),
    _detail_sql(_error_rate_sql(24 * 31), error_rate="score", error_count="error_count", total_count="log_count",
                baseline_rate="baseline_rate"),
    _detail_sql(_new_templates_sql(24 * 31), new_template_count="new_template_count",
                total_template_count="total_template_count", ratio="score"),
    _detail_sql(_on_replay(_rare_sql(24, before=True)), recent_count="recent_count", historical_avg="historical_avg",
                rare_threshold="rare_threshold"),
    _detail_sql(_on_replay(_silence_sql(24)), historical_avg="historical_avg", silent_hours="2"))))
def anomaly_report_details(spark, sf_dir):
    """The numbers in the details of report rows, one row per detail."""
    logs, replay = _logs(spark, sf_dir), _replay(spark, sf_dir)
    found = [D.detect_volume(logs, AS_OF, 24 * 31), D.detect_error_rate(logs, AS_OF, 24 * 31),
             D.detect_new_templates(logs, template_stats(logs), AS_OF, 24 * 31),
             D.detect_rare_templates(replay, AS_OF, 24, history_before=True), D.detect_source_silence(replay, AS_OF, 24)]
    rows = None
    for df in found:
        part = D.as_anomalies(df).select("timestamp", F.col("anomaly_type").alias("type"),
                                         F.explode("details").alias("key", "value"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.select("timestamp", "type", "key", F.col("value").try_cast("double").alias("number")).where(
        ~F.col("key").isin("expected_range", "template", "template_id", "source"))


@register("template_counts_7d", with_logs(
    f"SELECT template_id, count(*) AS count FROM logs_n "
    f"WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1"))
def template_counts_7d(spark, sf_dir):
    """Rows per template over the 7 days before as_of."""
    logs = _logs(spark, sf_dir)
    since = F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    return (logs.where((F.col("timestamp") >= since) & (F.col("event_date") >= F.to_date(since)))
            .groupBy("template_id").agg(F.count(F.lit(1)).alias("count")))


@register("template_count_p5", with_logs(
    f"SELECT quantile_cont(count, 0.05) AS p5 FROM (SELECT template_id, count(*) AS count FROM logs_n "
    f"WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1)"))
def template_count_p5(spark, sf_dir):
    """5th percentile (linear interpolation) of 7-day template counts."""
    return template_counts_7d(spark, sf_dir).agg(F.percentile("count", 0.05).alias("p5"))

"""DuckDB SQL that re-derives the parsed ``logs`` table from the ``events``
view, used as the independent oracle for the Spark queries.

Only the fixed values (patterns, maps, word lists) are shared with the Spark
code; the SQL is written separately in DuckDB's dialect.
"""

from __future__ import annotations

from .. import constants as K
from ..sources.event_lines import N_FILES, raw_lines_sql


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _group(pattern: str, idx: int, log_type: str, optional: bool = False) -> str:
    e = f"regexp_extract(line, {q(pattern)}, {idx})"
    if optional:
        e = f"nullif({e}, '')"
    return f"CASE WHEN log_type = {q(log_type)} THEN {e} END"


def _case_map(expr: str, mapping: dict) -> str:
    parts = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {parts} END)"


def _level_sql(msg: str) -> str:
    words = " ".join(f"WHEN regexp_matches({msg}, {q('(?i)' + p)}) THEN {q(lv)}"
                     for lv, p in K.LEVEL_WORD_RANKS)
    pri_digits = f"regexp_extract({msg}, {q(K.PRIORITY_RE)}, 1)"
    pri = f"CAST(right('00' || {pri_digits}, 3) AS INTEGER) % 8"
    sev = " ".join(f"WHEN {k} THEN {q(v)}" for k, v in K.SEVERITY_LEVELS.items())
    subs = []
    for lv, ws in K.LEVEL_SUBSTRINGS:
        cond = " OR ".join(f"contains(upper({msg}), {q(w)})" for w in ws)
        subs.append(f"WHEN {cond} THEN {q(lv)}")
    return (f"(CASE {words} WHEN {pri_digits} <> '' THEN (CASE {pri} {sev} END) "
            f"{' '.join(subs)} ELSE {q(K.DEFAULT_LEVEL)} END)")


def _distinct_keep_order(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def _ports_sql(msg: str) -> str:
    found = "list_concat(" + ", ".join(
        f"regexp_extract_all({msg}, {q(p)}, 1)" for p in K.PORT_RES) + ")"
    ok = f"list_filter({found}, lambda x: coalesce(TRY_CAST(x AS BIGINT) BETWEEN 1 AND 65535, false))"
    return _distinct_keep_order(ok)


def _protocols_sql(msg: str) -> str:
    found = "list_concat(" + ", ".join(
        f"regexp_extract_all({msg}, {q(p)}, 1)" for p in K.PROTOCOL_RES) + ")"
    up = f"list_transform({found}, lambda x: upper(x))"
    return _distinct_keep_order(up)


def _mask_sql(msg: str) -> str:
    out = msg
    for p in K.MASK_RES:
        out = f"regexp_replace({out}, {q(p)}, chr(1), 'g')"
    delims = "".join(K.EXTRA_DELIMITERS)
    spaced = f"regexp_replace(translate({out}, {q(delims)}, {q(' ' * len(delims))}), '^\\s+|\\s+$', '', 'g')"
    toks = (f"(CASE WHEN {spaced} = '' THEN []::VARCHAR[] "
            f"ELSE regexp_split_to_array({spaced}, '\\s+') END)")
    toks = f"list_transform({toks}, lambda t: replace(t, chr(1), {q(K.MASK_TOKEN)}))"
    return f"array_to_string({toks}, ' ')"


def _json(key: str) -> str:
    return f"json_extract_string(line, {q('$.' + key)})"


def logs_cte(lines: str | None = None) -> str:
    """``WITH`` body defining views raw_lines, logs (flattened), templates.
    ``lines``: CTEs ending in ``raw_lines`` (event_id, ts, source, line) to parse
    instead of those of ``events``."""
    raw = lines or "raw_lines AS (\n" + raw_lines_sql("duckdb", "events") + "\n)"
    strip = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"
    classify = ["CASE WHEN starts_with(stripped, '{') AND json_valid(line) THEN 'json'"]
    for name, pat in (("syslog", K.SYSLOG_RE), ("apache_access", K.APACHE_RE),
                      ("firewall", K.FIREWALL_RE), ("cisco_syslog", K.CISCO_RE),
                      ("windows_event", K.WINDOWS_RE), ("json_structured", K.JSON_STRUCTURED_RE),
                      ("docker", K.DOCKER_RE)):
        classify.append(f"WHEN regexp_matches(line, {q(pat)}) THEN {q(name)}")
    classify.append("ELSE 'unknown' END")

    g = {}
    for name, pat, groups, opt in (
            ("syslog", K.SYSLOG_RE, K.SYSLOG_GROUPS, ("pid",)),
            ("apache_access", K.APACHE_RE, K.APACHE_GROUPS, ("referer", "user_agent")),
            ("firewall", K.FIREWALL_RE, ("action", "src_ip", "dst_ip"), ()),
            ("cisco_syslog", K.CISCO_RE, K.CISCO_GROUPS, ("timezone",)),
            ("windows_event", K.WINDOWS_RE, K.WINDOWS_GROUPS, ()),
            ("docker", K.DOCKER_RE, K.DOCKER_GROUPS, ())):
        for i, grp in enumerate(groups, 1):
            g[f"{name}__{grp}"] = _group(pat, i, name, grp in opt)
    # a bare ':' captured as time zone is no time zone
    g["cisco_syslog__timezone"] = f"nullif({g['cisco_syslog__timezone']}, ':')"
    for key, pat in (("src_port", K.FIREWALL_SPT_RE), ("dst_port", K.FIREWALL_DPT_RE),
                     ("protocol", K.FIREWALL_PROTO_RE)):
        g[f"firewall__{key}"] = _group(pat, 4, "firewall", True)
    gcols = ",\n    ".join(f"{v} AS {k}" for k, v in g.items())

    json_ts = (f"CASE WHEN json_exists(line, '$.timestamp') THEN {_json('timestamp')} "
               f"ELSE {_json('time')} END")
    syslog_norm = "regexp_replace(syslog__timestamp, '\\s+', ' ', 'g')"
    sy_this = f"try_strptime(CAST(year(ingest_ts) AS VARCHAR) || ' ' || {syslog_norm}, '%Y %b %d %H:%M:%S')"
    sy_last = f"try_strptime(CAST(year(ingest_ts) - 1 AS VARCHAR) || ' ' || {syslog_norm}, '%Y %b %d %H:%M:%S')"
    ap = "apache_access__timestamp"
    ap_base = f"try_strptime(regexp_extract({ap}, '^(\\S+)\\s+[+-]\\d{{4}}$', 1), '%d/%b/%Y:%H:%M:%S')"
    ap_sign = f"(CASE WHEN regexp_extract({ap}, '([+-])\\d{{4}}$', 1) = '-' THEN -1 ELSE 1 END)"
    ap_min = (f"(TRY_CAST(regexp_extract({ap}, '[+-](\\d{{2}})\\d{{2}}$', 1) AS INTEGER) * 60 + "
              f"TRY_CAST(regexp_extract({ap}, '[+-]\\d{{2}}(\\d{{2}})$', 1) AS INTEGER))")
    parsed_ts = f"""CASE log_type
      WHEN 'json' THEN CAST(TRY_CAST({json_ts} AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP)
      WHEN 'syslog' THEN (CASE WHEN {sy_this} > ingest_ts + INTERVAL 1 DAY THEN {sy_last} ELSE {sy_this} END)
      WHEN 'apache_access' THEN {ap_base} - to_minutes(CAST({ap_sign} * {ap_min} AS BIGINT))
      WHEN 'windows_event' THEN try_strptime(regexp_replace(windows_event__timestamp, '\\s+', ' ', 'g'), '%Y-%m-%d %H:%M:%S')
      WHEN 'docker' THEN TRY_CAST(regexp_replace(docker__timestamp, 'Z$', '') AS TIMESTAMP)
    END"""
    message = f"""CASE log_type
      WHEN 'json' THEN coalesce({_json('message')}, {_json('msg')}, line)
      WHEN 'syslog' THEN syslog__message
      WHEN 'cisco_syslog' THEN cisco_syslog__message
      WHEN 'windows_event' THEN windows_event__message
      WHEN 'docker' THEN docker__message
      ELSE stripped END"""
    field_level = f"""CASE log_type
      WHEN 'json' THEN upper(coalesce({_json('level')}, {_json('severity')}, 'INFO'))
      WHEN 'firewall' THEN {_case_map('firewall__action', K.FIREWALL_LEVELS)}
      WHEN 'cisco_syslog' THEN coalesce({_case_map('cisco_syslog__severity', K.SEVERITY_LEVELS)}, 'INFO')
      WHEN 'windows_event' THEN windows_event__level
      WHEN 'docker' THEN docker__level
      ELSE 'INFO' END"""

    def nf(key):
        parts = [f"WHEN 'json' THEN {_json(key)}"]
        if key == "src_ip":
            parts.append("WHEN 'apache_access' THEN apache_access__remote_addr")
        if key == "protocol":
            parts.append("WHEN 'apache_access' THEN apache_access__protocol")
        if key in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol"):
            parts.append(f"WHEN 'firewall' THEN firewall__{key}")
        return f"CASE log_type {' '.join(parts)} END"

    proto_map = _case_map("nf_protocol", K.PROTOCOL_NAMES)
    fname = f"'file-' || CAST(event_id % {N_FILES} AS VARCHAR) || '.log'"

    return f"""{raw},
l0 AS (
  SELECT event_id, ts, source, line, {fname} AS filename, event_id AS ingest_seq, ts AS ingest_ts,
         {strip} AS stripped
  FROM raw_lines
),
l1 AS (
  SELECT *, {' '.join(classify)} AS log_type FROM l0 WHERE stripped <> ''
),
l2 AS (
  SELECT *,
    {gcols}
  FROM l1
),
l3 AS (
  SELECT event_id, ingest_seq, ingest_ts, source, filename, substr(md5(filename), 1, 16) AS file_id,
         log_type, line, l2.* EXCLUDE (event_id, ingest_seq, ingest_ts, source, filename, log_type, line, ts, stripped),
         ({message}) AS message,
         ({field_level}) AS field_level,
         coalesce(({parsed_ts}), ingest_ts) AS timestamp,
         {nf('src_ip')} AS nf_src_ip, {nf('dst_ip')} AS nf_dst_ip, {_json_only('ip_address')} AS nf_ip_address,
         {nf('src_port')} AS nf_src_port, {nf('dst_port')} AS nf_dst_port, {nf('protocol')} AS nf_protocol
  FROM l2
),
l4 AS (
  SELECT *,
    regexp_extract_all(message, {q(K.IP_RE)}, 1) AS ips,
    {_ports_sql('message')} AS port_list,
    {_protocols_sql('message')} AS proto_list,
    regexp_extract_all(message, {q(K.MAC_RE)}, 1) AS mac_list,
    CASE WHEN field_level = 'INFO' THEN {_level_sql('message')} ELSE field_level END AS level,
    {_mask_sql('message')} AS template
  FROM l3
),
logs AS (
  SELECT event_id, ingest_seq, file_id || '-' || CAST(ingest_seq AS VARCHAR) AS log_id,
    timestamp, level, message, source, log_type, file_id, filename,
    CASE WHEN len(ips) > 0 THEN ips END AS ip_addresses,
    CASE WHEN len(ips) >= 2 THEN ips[1] ELSE nf_src_ip END AS src_ip,
    CASE WHEN len(ips) >= 2 THEN ips[2] ELSE nf_dst_ip END AS dst_ip,
    CASE WHEN len(ips) = 1 THEN ips[1] ELSE nf_ip_address END AS ip_address,
    nf_src_port AS src_port, nf_dst_port AS dst_port,
    coalesce({proto_map}, nf_protocol) AS protocol,
    CASE WHEN len(port_list) > 0 THEN port_list END AS ports,
    CASE WHEN len(proto_list) > 0 THEN proto_list END AS protocols,
    CASE WHEN len(mac_list) > 0 THEN mac_list END AS mac_addresses,
    'tmpl_' || substr(md5(template), 1, {K.TEMPLATE_ID_HEX}) AS template_id, template,
    syslog__hostname, syslog__program, syslog__pid,
    apache_access__method, apache_access__url, apache_access__status, apache_access__size,
    apache_access__referer, apache_access__user_agent,
    firewall__action, cisco_syslog__timezone, cisco_syslog__facility, cisco_syslog__severity,
    cisco_syslog__mnemonic, windows_event__event_id, windows_event__source, docker__container_id,
    ingest_ts
  FROM l4
),
logs_n AS (
  SELECT *, (ip_addresses IS NOT NULL OR src_ip IS NOT NULL OR dst_ip IS NOT NULL
             OR ip_address IS NOT NULL OR src_port IS NOT NULL OR dst_port IS NOT NULL
             OR protocol IS NOT NULL OR ports IS NOT NULL OR protocols IS NOT NULL
             OR mac_addresses IS NOT NULL) AS has_network_info
  FROM logs
)"""


def _json_only(key: str) -> str:
    return f"CASE log_type WHEN 'json' THEN {_json(key)} END"


def with_logs(select_sql: str, extra_ctes: str = "", lines: str | None = None) -> str:
    """Full oracle query: the logs CTE (and any extra CTEs) followed by the
    given SELECT, which refers to the view ``logs_n`` (logs +
    has_network_info)."""
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {logs_cte(lines)}{extra}\n{select_sql}"

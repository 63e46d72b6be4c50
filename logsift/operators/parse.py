"""Line classification and parsing (P1-P20) as one narrow Spark stage.

Every step is a Catalyst expression, so the whole parse runs inside
whole-stage code generation next to the scan, with no shuffle.  The
classifier runs the format patterns once per line; the group extraction then
only evaluates the pattern of the format that won (CASE branches are lazy).

Output: the ``logs`` schema (see ``logsift.schema.LOGS_COLUMNS``) minus the
template columns, plus every input column that is passed through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.levels import extract_level
from ..functions.network import network_struct, null_if_empty_struct, raw_arrays
from ..functions.text import iso_time, json_object

# Java's '.' and '$' also stop at '\r' and Unicode line ends; UNIX_LINES makes
# them stop at '\n' only, like the patterns' original dialect.
_UNIX = "(?d)"

# type -> (pattern, group names)
_REGEX_TYPES = (
    ("syslog", K.SYSLOG_RE, K.SYSLOG_GROUPS),
    ("apache_access", K.APACHE_RE, K.APACHE_GROUPS),
    ("firewall", K.FIREWALL_RE, ("action", "src_ip", "dst_ip")),
    ("cisco_syslog", K.CISCO_RE, K.CISCO_GROUPS),
    ("windows_event", K.WINDOWS_RE, K.WINDOWS_GROUPS),
    ("json_structured", K.JSON_STRUCTURED_RE, ()),
    ("docker", K.DOCKER_RE, K.DOCKER_GROUPS),
)
# groups that may take no part in a match; '' from regexp_extract -> NULL
_OPTIONAL = {("syslog", "pid"), ("apache_access", "referer"), ("apache_access", "user_agent"),
             ("cisco_syslog", "timezone")}

# keys never copied into metadata
_JSON_PROMOTED = ("message", "msg", "level", "severity", "timestamp", "time")
_REGEX_PROMOTED = ("message", "level", "parsed_timestamp", "log_type",
                   "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "remote_addr")
_JSON_NETWORK = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ip_address")


_WHITESPACE = " \t\n\r\x0b\x0c"  # the ASCII whitespace class


def strip_text(c: Column) -> Column:
    """Python-style strip of surrounding (ASCII) whitespace."""
    return F.trim(c, F.lit(_WHITESPACE))


def _format_guard(name: str, line: Column) -> Column:
    """A cheap test implied by every match of the format's pattern, so the
    pattern only runs on lines that can match it."""
    has = line.contains
    return {
        "syslog": has(":"),
        "apache_access": has("[") & has('"'),
        "firewall": has("SRC=") & has("DST="),
        "cisco_syslog": has("-") & has(":"),
        "windows_event": has("-") & has(":"),
        "json_structured": F.startswith(line, F.lit("{")),
        "docker": has("T") & has("Z") & has(":"),
    }[name]


def classify(line: Column, json_map: Column) -> Column:
    """Log type of a raw line; first matching format wins."""
    expr = F.when(json_map.isNotNull(), F.lit("json"))
    for name, pattern, _ in _REGEX_TYPES:
        expr = expr.when(_format_guard(name, line) & line.rlike(_UNIX + pattern), F.lit(name))
    return expr.otherwise(F.lit("unknown"))


# Separator for extracting all groups of a match in one regex pass; a line
# that already holds it falls back to one extraction per group.
_SEP = "\u001f"


def all_groups(line: Column, pattern: str, n: int) -> Column:
    """Array of the ``n`` groups of the (start-anchored) pattern's match: one
    ``regexp_replace`` writes the groups joined by a separator (a group that
    takes no part gives ''), then ``split``.  Only used on lines known to
    match the pattern."""
    tail = "" if pattern.endswith("$") else "(?:.*)$"
    template = _SEP.join(f"${i}" for i in range(1, n + 1))
    one_pass = F.split(F.regexp_replace(line, _UNIX + pattern + tail, template), _SEP)
    per_group = F.array(*[F.regexp_extract(line, _UNIX + pattern, i) for i in range(1, n + 1)])
    return F.when(line.contains(_SEP), per_group).otherwise(one_pass)


def _group_from(arr: Column, log_type: Column, name: str, groups, g: str) -> Column:
    idx = groups.index(g)
    v = F.get(arr, idx)
    if (name, g) in _OPTIONAL:
        v = F.nullif(v, F.lit(""))
    if (name, g) == ("cisco_syslog", "timezone"):
        v = F.nullif(v, F.lit(":"))  # Q9: the pattern can capture a bare ':'
    return F.when(log_type == name, v)


def _group(line: Column, log_type: Column, name: str, pattern: str, groups, g: str) -> Column:
    idx = groups.index(g) + 1
    v = F.regexp_extract(line, _UNIX + pattern, idx)
    if (name, g) in _OPTIONAL:
        v = F.nullif(v, F.lit(""))
    if (name, g) == ("cisco_syslog", "timezone"):
        v = F.nullif(v, F.lit(":"))  # Q9: the pattern can capture a bare ':'
    return F.when(log_type == name, v)


def _syslog_time(stamp: Column, ingest_ts: Column) -> Column:
    """P12 + Q2: syslog has no year; take the ingest year, one less if that
    lands more than a day after the ingest time."""
    norm = F.regexp_replace(stamp, r"\s+", " ")
    fmt = F.lit("yyyy MMM d HH:mm:ss")
    y = F.year(ingest_ts)
    this_year = F.try_to_timestamp(F.concat(y.cast("string"), F.lit(" "), norm), fmt)
    last_year = F.try_to_timestamp(F.concat((y - 1).cast("string"), F.lit(" "), norm), fmt)
    return F.when(this_year > ingest_ts + F.expr("INTERVAL 1 DAY"), last_year).otherwise(this_year)


def parse_lines(df: DataFrame, line: str = "line", ingest_ts: str = "ingest_ts",
                source: str = "source") -> DataFrame:
    """Parse raw lines into typed log rows.

    ``df`` needs a text column ``line``, an ``ingest_ts`` timestamp (the time
    given to lines that carry none) and a ``source`` column.  Blank lines are
    dropped (they are counted as failed by the file registry, P11).
    Other columns pass through unchanged.
    """
    passthrough = [c for c in df.columns if c not in (line, ingest_ts, source)]
    L = F.col(line)
    stripped = strip_text(L)
    df = df.where(stripped != "")

    # --- stage 1: strip, JSON attempt, classify --------------------------
    json_map = F.when(F.startswith(stripped, F.lit("{")), json_object(L))
    s1 = df.select(*[F.col(c) for c in passthrough],
                   L.alias("_line"), stripped.alias("_stripped"),
                   F.col(ingest_ts).alias("_ingest_ts"), F.col(source).alias("source"),
                   json_map.alias("_json"))
    s1 = s1.withColumn("log_type", classify(F.col("_line"), F.col("_json")))

    # --- stage 2: groups of the winning format ----------------------------
    line_c, t = F.col("_line"), F.col("log_type")
    arrays = {}
    for name, pattern, groups in _REGEX_TYPES:
        if groups:
            arrays[name] = F.when(t == name, all_groups(line_c, pattern, len(groups)))
    s1 = s1.withColumn("_groups", F.coalesce(*arrays.values()))
    grp = {}
    for name, pattern, groups in _REGEX_TYPES:
        for g in groups:
            grp[(name, g)] = _group_from(F.col("_groups"), t, name, groups, g)
    # Q1: ports and protocol are taken after DST, each on its own
    for key, pattern in (("src_port", K.FIREWALL_SPT_RE), ("dst_port", K.FIREWALL_DPT_RE),
                         ("protocol", K.FIREWALL_PROTO_RE)):
        v = F.nullif(F.regexp_extract(line_c, _UNIX + pattern, 4), F.lit(""))
        grp[("firewall", key)] = F.when(t == "firewall", v)

    s2 = s1.select(
        *[F.col(c) for c in passthrough], "_line", "_stripped", "_ingest_ts", "source",
        "_json", "log_type",
        *[c.alias(f"_g_{n}_{g}") for (n, g), c in grp.items()])

    def G(n, g):
        return F.col(f"_g_{n}_{g}")

    j = F.col("_json")
    # --- stage 3: message, level, time, fields ----------------------------
    message = (F.when(t == "json", F.coalesce(j["message"], j["msg"], line_c))
               .when(t == "syslog", G("syslog", "message"))
               .when(t == "cisco_syslog", G("cisco_syslog", "message"))
               .when(t == "windows_event", G("windows_event", "message"))
               .when(t == "docker", G("docker", "message"))
               .otherwise(F.col("_stripped")))
    json_ts_text = F.when(F.map_contains_key(j, "timestamp"), j["timestamp"]).otherwise(j["time"])
    parsed_ts = (F.when(t == "json", iso_time(json_ts_text))
                 .when(t == "syslog", _syslog_time(G("syslog", "timestamp"), F.col("_ingest_ts")))
                 .when(t == "apache_access",
                       F.try_to_timestamp(G("apache_access", "timestamp"),
                                          F.lit("dd/MMM/yyyy:HH:mm:ss Z")))
                 .when(t == "windows_event",
                       F.try_to_timestamp(F.regexp_replace(G("windows_event", "timestamp"),
                                                           r"\s+", " "),
                                          F.lit("yyyy-MM-dd HH:mm:ss")))
                 .when(t == "docker", F.try_to_timestamp(G("docker", "timestamp"))))
    fw_levels = F.create_map(*[x for k, v in K.FIREWALL_LEVELS.items() for x in (F.lit(k), F.lit(v))])
    sev_levels = F.create_map(*[x for k, v in K.SEVERITY_LEVELS.items() for x in (F.lit(k), F.lit(v))])
    field_level = (F.when(t == "json", F.upper(F.coalesce(j["level"], j["severity"], F.lit("INFO"))))
                   .when(t == "firewall", F.try_element_at(fw_levels, G("firewall", "action")))
                   .when(t == "cisco_syslog",
                         F.coalesce(F.try_element_at(sev_levels, G("cisco_syslog", "severity")),
                                    F.lit("INFO")))
                   .when(t == "windows_event", G("windows_event", "level"))
                   .when(t == "docker", G("docker", "level"))
                   .otherwise(F.lit("INFO")))

    def net_field(key):
        e = F.when(t == "json", j[key])
        if key == "src_ip":
            e = e.when(t == "apache_access", G("apache_access", "remote_addr"))
        if key == "protocol":
            e = e.when(t == "apache_access", G("apache_access", "protocol"))
        if key in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol"):
            e = e.when(t == "firewall", G("firewall", key))
        return e

    # parsed_fields / metadata
    def regex_map(name, groups, extra=()):
        keys = list(groups) + list(extra)
        kv = []
        for g in keys:
            kv += [F.lit(g), G(name, g)]
        return F.create_map(*kv) if kv else F.create_map().cast("map<string,string>")

    fw_groups = ("action", "src_ip", "dst_ip", "src_port", "dst_port", "protocol")
    type_groups = {n: g for n, _, g in _REGEX_TYPES}
    type_groups["firewall"] = fw_groups
    parsed_fields = F.when(t == "json", j)
    metadata = F.when(t == "json", F.map_filter(j, lambda k, v: ~k.isin(*_JSON_PROMOTED)))
    for name, groups in type_groups.items():
        pf = F.map_concat(regex_map(name, groups),
                          F.create_map(F.lit("log_type"), F.lit(name)))
        kept = [g for g in groups if g not in _REGEX_PROMOTED]
        parsed_fields = parsed_fields.when(t == name, pf)
        metadata = metadata.when(t == name, regex_map(name, kept))
    empty = F.create_map().cast("map<string,string>")
    parsed_fields = parsed_fields.otherwise(empty)
    metadata = metadata.otherwise(empty)

    # A time in the line that is none; the row keeps the ingest time
    has_time = F.when(t == "json", json_ts_text.isNotNull()).otherwise(
        t.isin("syslog", "apache_access", "windows_event", "docker"))

    s3 = s2.select(
        *[F.col(c) for c in passthrough], "source", "log_type", "_ingest_ts",
        (has_time & parsed_ts.isNull()).alias("_parse_error"),
        message.alias("message"),
        field_level.alias("_field_level"),
        F.coalesce(parsed_ts, F.col("_ingest_ts")).alias("timestamp"),
        *[net_field(k).alias(f"_nf_{k}") for k in _JSON_NETWORK],
        parsed_fields.alias("parsed_fields"),
        metadata.alias("metadata"),
    )

    # --- stage 4: found arrays, each regex pass once per row ---------------
    msg = F.col("message")
    arrays = raw_arrays(msg)
    s3 = s3.select("*", *[c.alias(f"_a_{k}") for k, c in arrays.items()])

    # --- stage 5: level re-derivation (P18) and network facts (P14, P19) ---
    level = F.when(F.col("_field_level") == "INFO", extract_level(msg)).otherwise(F.col("_field_level"))
    ni = network_struct(F.col("_a_ips"), F.col("_a_ports"), F.col("_a_protocols"), F.col("_a_macs"),
                        F.col("_nf_src_ip"), F.col("_nf_dst_ip"), F.col("_nf_ip_address"),
                        F.col("_nf_src_port"), F.col("_nf_dst_port"), F.col("_nf_protocol"))
    s4 = s3.select(
        *[F.col(c) for c in passthrough], "timestamp", level.alias("level"), "message", "source",
        "log_type", ni.alias("network_info"), "parsed_fields", "metadata",
        F.col("_ingest_ts").alias("ingest_ts"), F.col("_parse_error").alias("parse_error"))
    out = s4.withColumn("network_info", null_if_empty_struct("network_info"))
    # Barrier: a later filter on a parsed column (level, network_info, ...)
    # must run on the parse output, not be pushed through these projections,
    # where Catalyst would substitute (and multiply) the regex expressions.
    # Filters are not pushed through a metrics node; it also counts the rows.
    return out.observe(f"logsift_parse_{uuid.uuid4().hex[:12]}", F.count(F.lit(1)).alias("rows"))

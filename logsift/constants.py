"""Fixed values the parsers, extractors and detectors must share with the
behaviour they reproduce (formats, word lists, maps, thresholds).

Everything in the "fixed values" blocks below is data, not logic: it has to
stay exactly as written for the results to match.  Patterns are written in the
Java regex dialect used by Spark (``\\d``, ``\\w``, ``\\b`` are ASCII there).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# fixed values: line formats, tried in this order, first match wins
# ---------------------------------------------------------------------------
SYSLOG_RE = (
    r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)$"
)
SYSLOG_GROUPS = ("timestamp", "hostname", "program", "pid", "message")

APACHE_RE = (
    r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+(\S+)"\s+(\d+)\s+(\S+)'
    r'(?:\s+"([^"]*)")?\s*(?:"([^"]*)")?'
)
APACHE_GROUPS = ("remote_addr", "timestamp", "method", "url", "protocol", "status",
                 "size", "referer", "user_agent")

FIREWALL_RE = (
    r"^.*?(ACCEPT|DENY|DROP|REJECT).*?SRC=(\d+\.\d+\.\d+\.\d+).*?DST=(\d+\.\d+\.\d+\.\d+)"
)
# Ports and protocol are looked up after the DST part, each on its own.
FIREWALL_SPT_RE = FIREWALL_RE + r".*?SPT=(\d+)"
FIREWALL_DPT_RE = FIREWALL_RE + r".*?DPT=(\d+)"
FIREWALL_PROTO_RE = FIREWALL_RE + r".*?PROTO=(\w+)"
FIREWALL_LEVELS = {"ACCEPT": "INFO", "DENY": "WARN", "DROP": "WARN", "REJECT": "ERROR"}

CISCO_RE = (
    r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}(?:\.\d{3})?)\s*(\S+)?\s*:?\s*%?(\w+)-(\d+)-(\w+):\s*(.*)$"
)
CISCO_GROUPS = ("timestamp", "timezone", "facility", "severity", "mnemonic", "message")
SEVERITY_LEVELS = {
    "0": "EMERGENCY", "1": "ALERT", "2": "CRITICAL", "3": "ERROR",
    "4": "WARN", "5": "NOTICE", "6": "INFO", "7": "DEBUG",
}

WINDOWS_RE = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+(\w+)\s+(\d+)\s+(\S+)\s+(.*)$"
WINDOWS_GROUPS = ("timestamp", "level", "event_id", "source", "message")

JSON_STRUCTURED_RE = r"^\{.*\}$"

DOCKER_RE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\s+(\w+)\s+(\w+)\s+(.*)$"
DOCKER_GROUPS = ("timestamp", "level", "container_id", "message")

LOG_TYPES = ("json", "syslog", "apache_access", "firewall", "cisco_syslog",
             "windows_event", "json_structured", "docker", "unknown")

# ---------------------------------------------------------------------------
# fixed values: protocol numbers
# ---------------------------------------------------------------------------
PROTOCOL_NAMES = {
    "1": "ICMP", "6": "TCP", "17": "UDP", "47": "GRE", "50": "ESP", "51": "AH",
    "58": "ICMPv6", "89": "OSPF", "132": "SCTP",
}

# ---------------------------------------------------------------------------
# fixed values: level words, ranked; the first rank found anywhere wins
# ---------------------------------------------------------------------------
LEVEL_WORD_RANKS = (
    ("EMERGENCY", r"\b(EMERGENCY|EMERG|PANIC)\b"),
    ("ALERT", r"\b(ALERT)\b"),
    ("CRITICAL", r"\b(CRITICAL|CRIT|FATAL)\b"),
    ("ERROR", r"\b(ERROR|ERR|FAIL|FAILED)\b"),
    ("WARN", r"\b(WARNING|WARN|NOTICE)\b"),
    ("INFO", r"\b(INFO|INFORMATION)\b"),
    ("DEBUG", r"\b(DEBUG|TRACE)\b"),
)
PRIORITY_RE = r"<(\d+)>"
# substring rules, checked on the upper-cased text in this order
LEVEL_SUBSTRINGS = (
    ("ERROR", ("FAIL", "ERROR", "EXCEPTION", "CRASH")),
    ("WARN", ("WARN", "ALERT", "DENY", "BLOCK")),
    ("DEBUG", ("DEBUG", "TRACE")),
)
DEFAULT_LEVEL = "INFO"

# ---------------------------------------------------------------------------
# fixed values: network facts found in free text
# ---------------------------------------------------------------------------
IP_RE = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
PORT_RES = (
    r"(?i)(?:port|PORT)\s*[=:]\s*(\d+)",
    r"(?i)(?:src_port|SRC_PORT|SPT)\s*[=:]\s*(\d+)",
    r"(?i)(?:dst_port|DST_PORT|DPT)\s*[=:]\s*(\d+)",
    r"(?i):(\d+)\b",
)
PROTOCOL_RES = (
    r"(?i)(?:proto|protocol|PROTO)\s*[=:]\s*(\w+)",
    r"(?i)\b(TCP|UDP|ICMP|HTTP|HTTPS|FTP|SSH|SMTP|DNS|DHCP|SNMP)\b",
)
MAC_RE = r"\b((?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2})\b"

# ---------------------------------------------------------------------------
# fixed values: template masking and tokenising
# ---------------------------------------------------------------------------
MASK_RES = (
    r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    r"\b[a-fA-F0-9]{32,}\b",
    r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z\b",
    r"\b\d{6,}\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
)
MASK_TOKEN = "<*>"
EXTRA_DELIMITERS = (
    ":", "=", ",", '"', "'", "[", "]", "(", ")", "{", "}",
    "<", ">", "|", "\\", "/", "?", "!", ";", "&", "%",
    "$", "#", "@", "^", "*", "+", "-", "_", "~", "`",
)
# template ids: prefix + this many hex digits of md5(template text); 64 bits
# keep distinct templates apart even with billions of them (our rule)
TEMPLATE_ID_HEX = 16
DRAIN_DEPTH = 4
DRAIN_SIMILARITY = 0.4
DRAIN_MAX_CHILDREN = 100
DRAIN_MAX_CLUSTERS = 1000

# ---------------------------------------------------------------------------
# fixed values: detector thresholds and level sets
# ---------------------------------------------------------------------------
VOLUME_Z_THRESHOLD = 3.0
VOLUME_HIGH_Z = 5.0
VOLUME_MAX_WINDOW = 24
ERROR_RATE_THRESHOLD = 0.1
ERROR_RATE_CRITICAL = 0.5
NEW_TEMPLATE_THRESHOLD = 0.05
NEW_TEMPLATE_HIGH = 0.2
RARE_TEMPLATE_PERCENTILE = 5
RARE_RECENT_FACTOR = 3
IFOREST_CONTAMINATION = 0.1
IFOREST_TREES = 100
IFOREST_MAX_SAMPLES = 256
IFOREST_SEED = 42
IFOREST_MIN_LOGS = 100
IFOREST_MIN_HOURS = 24
SILENCE_MIN_ROWS = 10
SILENCE_MIN_MEAN = 5
SILENCE_RECENT_HOURS = 2
EPSILON = 1e-6

# three different "error" sets are used; they are kept apart on purpose
ERROR_RATE_LEVELS = ("ERROR", "CRITICAL", "FATAL", "WARN")   # error-rate detector
ML_ERROR_LEVELS = ("ERROR", "CRITICAL", "FATAL")             # hourly features
CLIENT_ERROR_LEVELS = ("ERROR",)                              # file error rate

ALL_LEVELS = ("EMERGENCY", "ALERT", "CRITICAL", "ERROR", "WARN", "NOTICE", "INFO", "DEBUG")

# ---------------------------------------------------------------------------
# our rule (the chart only names the categories): keyword -> error category
# ---------------------------------------------------------------------------
ERROR_CATEGORIES = (
    ("database", ("database", "sql", "query", "db ")),
    ("network", ("network", "connection", "timeout", "socket")),
    ("authentication", ("auth", "password", "login", "credential")),
    ("validation", ("validation", "invalid", "malformed")),
)

# ---------------------------------------------------------------------------
# fixed values: sources
# ---------------------------------------------------------------------------
ACCEPTED_EXTENSIONS = (".log", ".txt", ".json")
COLLECTOR_DEFAULT_SOURCE = "fluent-bit"
CONTAINER_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS"
# collector syslog parser: pri, time, host, ident, pid, message
SYSLOG_PRI_RE = r"^\<([0-9]+)\>([^ ]* {1,2}[^ ]* [^ ]*) ([^ ]*) ([a-zA-Z0-9_\/\.\-]*)(?:\[([0-9]+)\])?(?:[^\:]*\:)? *(.*)$"
SYSLOG_PRI_GROUPS = ("pri", "time", "host", "ident", "pid", "message")

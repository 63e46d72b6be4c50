"""Golden lines, one per rule (FIXTURES.md section 2)."""
import datetime as dt

import pytest

from logsift.operators.parse import parse_lines

INGEST = dt.datetime(2024, 1, 2, 0, 0, 0)

GOLDEN = [
    # line, log_type, level, checks on the parsed row
    ("Dec  1 10:00:00 web1 sshd[42]: Failed password from 10.0.0.1 port: 22", "syslog", "ERROR",
     {"pid": "42", "ip_address": "10.0.0.1", "ports": ["22"], "ts": dt.datetime(2023, 12, 1, 10)}),
    ("Dec  1 10:00:00 web1 cron: job ok", "syslog", "INFO", {"pid": None}),
    ('1.2.3.4 - - [10/Oct/2023:13:55:36 -0700] "GET /error HTTP/1.1" 200 12', "apache_access",
     "ERROR", {"ts": dt.datetime(2023, 10, 10, 20, 55, 36), "referer": None, "src_ip": "1.2.3.4",
               "protocol": "HTTP/1.1"}),
    ('1.2.3.4 - - [10/Oct/2023:13:55:36 -0700] "GET /error HTTP/1.1" 200 12 "-" "curl/8"',
     "apache_access", "ERROR", {"user_agent": "curl/8"}),
    ("fw DROP IN=e0 SRC=1.2.3.4 DST=5.6.7.8 PROTO=6 SPT=11 DPT=22", "firewall", "WARN",
     {"src_ip": "1.2.3.4", "dst_ip": "5.6.7.8", "src_port": "11", "dst_port": "22",
      "protocol": "TCP"}),
    ("fw REJECT SRC=1.2.3.4 DST=5.6.7.8", "firewall", "ERROR", {"src_port": None, "ports": None}),
    ("Dec  1 10:00:00.123: %LINK-3-UPDOWN: Interface down", "cisco_syslog", "ERROR",
     {"mnemonic": "UPDOWN", "timezone": None}),
    ("Dec  1 10:00:00.123: %SYS-5-CONFIG_I: done", "cisco_syslog", "NOTICE", {}),
    ("2024-01-01 00:00:00 Error 4004 svc-a failed", "windows_event", "Error",
     {"ts": dt.datetime(2024, 1, 1)}),
    ("2024-01-01T00:00:00.123456Z INFO abc123 tcp connection failed", "docker", "ERROR",
     {"protocols": ["TCP"], "ts": dt.datetime(2024, 1, 1, 0, 0, 0, 123456)}),
    ("2024-01-01T00:00:00.123456789Z WARN abc123 x", "docker", "WARN",
     {"ts": dt.datetime(2024, 1, 1, 0, 0, 0, 123456)}),
    ('{"time":"2024-01-01T00:00:00Z","severity":"warn","msg":"x","src_ip":"10.0.0.9"}', "json",
     "WARN", {"message": "x", "meta_keys": ["src_ip"], "ts": dt.datetime(2024, 1, 1)}),
    ('{"message":"x","level":3,"protocol":17}', "json", "3", {"protocol": "UDP"}),
    ("{broken}", "json_structured", "INFO", {}),
    ('{"message":"x"} trailing text', "unknown", "INFO", {"message": '{"message":"x"} trailing text'}),
    ('{"message":"x"}, {"message":"y"}', "json_structured", "INFO", {}),
    ('{"message":"x"}] rest', "unknown", "INFO", {}),
    ("{'message':'x'}", "json_structured", "INFO", {}),
    ('  {"message":"x","a":{"b":[1]}} ', "json", "INFO", {"message": "x"}),
    ('{"message":"x","time":"10:00"}', "json", "INFO", {"ts": INGEST}),
    ('{"message":"x","time":"2024"}', "json", "INFO", {"ts": INGEST}),
    ("<131>disk", "unknown", "ERROR", {}),
    ("<5>hello", "unknown", "NOTICE", {}),
    ("connection blocked aa:bb:cc:dd:ee:01", "unknown", "WARN",
     {"mac_addresses": ["aa:bb:cc:dd:ee:01"], "ports": ["01"]}),
    ("NOTICE: disk almost full", "unknown", "WARN", {}),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, line, INGEST, "test") for i, (line, *_rest) in enumerate(GOLDEN)]
    rows.append((len(GOLDEN), "   ", INGEST, "test"))
    df = spark.createDataFrame(rows, "ingest_seq long, line string, ingest_ts timestamp, source string")
    out = parse_lines(df).orderBy("ingest_seq").collect()
    return {r["ingest_seq"]: r for r in out}


def test_blank_line_dropped(parsed):
    assert len(GOLDEN) not in parsed


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(parsed, i):
    line, log_type, level, checks = GOLDEN[i]
    r = parsed[i]
    assert r["log_type"] == log_type, line
    assert r["level"] == level, line
    ni = r["network_info"]
    md = r["metadata"] or {}
    for k, v in checks.items():
        if k == "ts":
            assert r["timestamp"] == v, line
        elif k == "message":
            assert r["message"] == v
        elif k == "meta_keys":
            assert sorted(md.keys()) == v
        elif k in ("pid", "referer", "user_agent", "mnemonic", "timezone"):
            assert md.get(k) == v, (line, k, md)
        else:
            got = None if ni is None else ni[k]
            assert got == v, (line, k, got)

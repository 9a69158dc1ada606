"""Fields of a DNS log row are parsed once, however often they are used."""

import re

from homelens.sources import dns_log

ROWS = [
    '{"id":1,"time":1704067200,"domain":" A.example ","status":"GRAVITY","client":{"ip":"10.0.0.1","name":" n "}}',
    '{"id":2,"timestamp":"2024-01-01T00:00:00Z","domain":"b","client":"10.0.0.2"}',
    '{"id":3,"time":1,"domain":"c","client":"{\\"ip\\":\\"9\\"}","client_ip":"10.0.0.3","name":"m"}',
    '{"id":4,"time":"x","domain":"d","ip":"10.0.0.4"}',
    '{"id":5,"time":1,"domain":" ","ip":"10.0.0.4"}',
    '{"id":6,"time":1,"domain":"e"}',
    '{"legacy_row":[1]}',
    "not json",
    None,
]


def test_fields_are_parsed_once(spark):
    out = dns_log.normalize_queries(spark.createDataFrame([(r,) for r in ROWS], "payload string").repartition(2))
    got = sorted((r["source_id"] or "", r["client_ip"], r["client_identifier"], r["domain"], r["status"], r["error"]) for r in out.collect() if r["source_id"])
    assert got == [
        ("1", "10.0.0.1", "n", "A.example", "blocked", None), ("2", "10.0.0.2", "10.0.0.2", "b", "allowed", None), ("3", "10.0.0.3", "m", "c", "allowed", None),
        ("4", "10.0.0.4", "10.0.0.4", "d", "allowed", "no time"), ("5", "10.0.0.4", "10.0.0.4", None, "allowed", "no domain"), ("6", None, None, "e", "allowed", "no client"),
    ]
    assert sorted(r["error"] for r in out.collect() if not r["source_id"]) == ["legacy row", "no time", "no time"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"get_json_object\(", plan)) <= len(dns_log.FIELDS)

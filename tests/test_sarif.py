"""SARIF logs: what is written is read back, whatever stands in the rows."""

import json

from tracebed.sources import reports

SCHEMA = "finding_no bigint, rule_id string, severity string, confidence string, tool string, file string, start_line int, end_line int, message string, fingerprint string, semantic_fingerprint string, suppressed boolean, log string, position int"


def test_logs(spark):
    rows = [
        (1, "b.rule", "HIGH", "HIGH", "t", "src\\a b/ü*~+.py", 3, 2, 'say "x"\n', "f", "s", False, "clash", 9),
        (2, "a.rule", " low ", None, None, None, None, None, "", None, " ", None, "clash", 9),
        (3, None, None, None, "t", "./x//y.py", -4, 7, None, "", "", False, "clash", 9),
        (4, "b.rule", "MEDIUM", "LOW", "t", "a", 1, 1, "m", "f", "s", True, "clash", 9),
        (None, "b.rule", "HIGH", "LOW", "t", "a", 1, 1, "m", "f", "s", False, "clash", 9),
        (5, "b.rule", "CRITICAL", "LOW", "t", "a", 1, 1, "m", "f", "s", False, "clash", 9),
    ]
    logs = reports.sarif_logs(spark.createDataFrame(rows + rows[:2], SCHEMA), per_log=3)
    texts = {r.log_no: json.loads(r.log) for r in logs.collect()}
    assert sorted(texts) == [0, 1]
    run = texts[0]["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["a.rule", "b.rule"]
    assert [(r["properties"]["findingNo"], r["ruleIndex"], r["level"]) for r in run["results"]] == [(5, 1, "error"), (1, 1, "error"), (2, 0, "note")]
    first = run["results"][1]
    assert first["message"]["text"] == 'say "x"\n'
    assert first["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "src/a%20b/%C3%BC%2A~%2B.py", "uriBaseId": "%SRCROOT%"}, "region": {"startLine": 3, "endLine": 3}}
    got = {r.finding_no: r for r in reports.sarif_results(logs).collect()}
    assert all(r.named == r.rule_id for r in got.values()) and sorted(got) == [1, 2, 3, 5]
    assert (got[2].uri, got[2].start_line, got[2].message_chars) == ("", 1, 6)
    assert (got[3].uri, got[3].start_line, got[3].end_line, got[3].rule_id, got[3].prints) == ("x/y.py", 1, 7, "", 0)


def test_empty_table(spark):
    assert reports.sarif_logs(spark.createDataFrame([], SCHEMA)).collect() == []

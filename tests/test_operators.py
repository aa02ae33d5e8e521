"""Small cases of the operators over findings, code and reports: nulls, empty tables, ties, repeated rows."""

import json

import pytest
from pyspark.sql import functions as F

from tracebed.functions.text import plain_path, utc_time
from tracebed.operators import code, duplicates, findings, flows, packages, state
from tracebed.sources import reports

SCAN = (
    "finding_no bigint, project string, tool string, rule_id string, category string, severity string, confidence string, precision_level string, cwe array<string>, file string, start_line int, end_line int, "
    "message string, code_snippet string, normalized_type string, fingerprint string, semantic_fingerprint string, detected_by array<string>, suppressed boolean, source_kind string, sink_kind string, endpoint string, "
    "http_method string, reachable boolean, authentication_required boolean, internet_exposed boolean, exploitability_score double, confidence_score double, correlation_score double, lifecycle_status string, secret_related_locations array<string>"
)
NAMES = [f.split()[0] for f in SCAN.split(", ")]


def scan(spark, *rows):
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], SCAN)


def test_plain_path_and_time(spark):
    cases = {" a//b ": "a/b", "./a/./b": "a/b", "a\\b\\..\\c": "a/c", "/../a": "/a", "../a/..": "..", "a/..": None, "": None, None: None, "a..b/c.": "a..b/c."}
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", plain_path(F.col("p")).alias("q"))
    assert {r.p: r.q for r in df.collect()} == cases
    times = spark.createDataFrame([("2026-01-02T03:04:05Z",), ("2026-01-02 03:04:05.000",), ("soon",), (None,)], "t string").select(utc_time(F.col("t")).alias("t")).collect()
    assert times[0].t == times[1].t and times[2].t is None and times[3].t is None


def test_all_null_row_and_empty_table_survive_every_operator(spark):
    for table in (scan(spark), scan(spark, {"finding_no": 1}), scan(spark, {"finding_no": 1}, {"finding_no": 1})):
        n = table.distinct().count()
        assert findings.position_fingerprint(table).count() == n
        assert findings.semantic_identity(table).count() == n
        assert findings.precision_gate(table).where("kept").count() == n
        assert findings.merged_findings(table).count() == n
        assert findings.numbered(table).count() == n
        assert flows.flow_matches(table, [flows.FlowQuery("q")]).count() == 0
        assert flows.attack_edges(table).count() == 0
        assert flows.secret_clusters(table).count() == 0


def test_gates_of_the_profiles(spark):
    rows = [
        {"tool": "x", "precision_level": "MEDIUM", "confidence": "LOW"},
        {"tool": "our-engine", "precision_level": "HIGH", "confidence": "low "},
        {"tool": "our-engine", "precision_level": "HIGH", "confidence": "LOW", "correlation_score": 0.85},
        {"tool": "x", "precision_level": "experimental", "confidence": "HIGH"},
        {"tool": "x", "precision_level": "EXPERIMENTAL", "confidence": "HIGH", "detected_by": ["a", "b"]},
        {"tool": "x", "precision_level": "HIGH", "confidence": "HIGH", "detected_by": ["a", "b"]},
        {"tool": "x", "precision_level": "HIGH", "confidence": "MEDIUM", "detected_by": ["a", "b"]},
        {"tool": "x", "precision_level": "VERY_HIGH", "confidence": "LOW", "detected_by": ["a", "a"]},
        {},
    ]
    table = scan(spark, *({"finding_no": i, **r} for i, r in enumerate(rows)))
    kept = lambda profile: {r.finding_no for r in findings.precision_gate(table, profile).where("kept").collect()}
    assert kept("smart") == {0, 2, 4, 5, 6, 7, 8} and kept("audit") == {0, 1, 2, 4, 5, 6, 7, 8} and kept("strict") == {5, 7} and len(kept("experimental")) == 9


def test_suppression_order_scope_and_fingerprints(spark):
    table = scan(
        spark,
        {"finding_no": 1, "rule_id": "r", "file": "a/b.py", "fingerprint": "sha256:f1"},
        {"finding_no": 2, "rule_id": "s", "file": "a/b.py", "semantic_fingerprint": "s2"},
        {"finding_no": 3, "rule_id": "g", "file": "a/b.py"},
        {"finding_no": 4, "rule_id": "q", "file": "c.py"},
        {"finding_no": 5},
    )
    entries = [
        {"reason": "old", "rule": "r", "expires": "2025-12-31"}, {"reason": "path alone never matches", "path": "*"}, {"reason": "rule", "rule": "r", "path": "a/*", "expires": "2026-01-01", "approved_by": "me"},
        {"fingerprint": "sha256:s2"}, {"reason": "wrong path", "rule": "q", "path": "a/*"},
    ]
    got = lambda **k: {(r.finding_no, r.reason) for r in findings.suppressed_by(table, entries, "2026-01-01", **k).collect()}
    assert got() == {(1, "rule (approved by me)"), (2, "scoped suppression")}
    assert got(fingerprints=("f1",), rules=("g", "r")) == {(1, "fingerprint"), (2, "scoped suppression"), (3, "rule")}


def test_policies_and_failing_severities(spark):
    rows = [("HIGH", "security", "a/x.py", None), ("low", "security", "a/x.py", None), ("CRITICAL", "secret", "b.py", False), ("HIGH", "security", "a/y.py", True), (None, "secret", None, None)]
    table = scan(spark, *({"finding_no": i, "severity": s, "category": c, "file": f, "suppressed": x} for i, (s, c, f, x) in enumerate(rows)))
    got = findings.policy_violations(table, [findings.Policy("p", "MEDIUM", ("security",), "a/*"), findings.Policy("q", "INFO", ("secret", "security"))]).collect()
    assert {(r.policy, r.finding_no) for r in got} == {("p", 0), ("q", 0), ("q", 1), ("q", 2)}
    assert {r.finding_no for r in findings.failing(table, "high").collect()} == {0, 2}
    with pytest.raises(ValueError):
        findings.failing(table, "worst")


def test_risk_is_a_whole_number_and_unknown_confidence_counts_less(spark):
    from tracebed.operators import metrics

    table = scan(spark, *({"finding_no": i, "project": p, "severity": "LOW", "category": "security", "confidence_score": c, "confidence": k} for i, (p, c, k) in enumerate([("a", 1.0, None), ("b", None, "?"), *[("c", 1.0, None)] * 9])))
    got = {r.project: (r.raw, r.risk, r.band) for r in metrics.risk_by_project(table).collect()}
    # 19.4 of 100 rounds to 19, which is LOW still
    assert got["a"] == (1.0, 2, "LOW") and got["b"] == (0.85, 2, "LOW") and got["c"] == (9.0, 20, "MODERATE")
    roots = scan(spark, {"finding_no": 1, "file": "x.py", "severity": "LOW"}, {"finding_no": 2, "file": "a/x.py", "severity": "LOW"})
    assert {r.place for r in metrics.hotspots(roots).where("kind = 'folder'").collect()} == {"(root)/", "a/"}


def test_numbers_that_need_names(spark):
    lines = ["a(100, 0xFF, 300)", "a(100, 200)", "x1000 v1.200 .300 000 0x1 001", "f(100,200,300,4)"]
    files = spark.createDataFrame([(1, lines, "p")], "file_no bigint, lines array<string>, path string").selectExpr("*", "cast(null as timestamp_ntz) indexed_at")
    assert {(r.line_no, r.n) for r in code.magic_numbers(files).collect()} == {(1, 3), (4, 3)}
    sizes = spark.createDataFrame([(i, ["x"] * n) for i, n in enumerate([399, 400, 800])] + [(9, None)], "file_no bigint, lines array<string>").selectExpr("*", "cast(null as timestamp_ntz) indexed_at")
    assert {(r.file_no, r.severity) for r in code.file_sizes(sizes).collect()} == {(0, None), (1, "LOW"), (2, "HIGH"), (9, None)}


INDEX = "snapshot_no int, semantic_fingerprint string, fingerprint string, rule_id string, file string, severity string, last_seen string, active int, at int"


def index(spark, rows):
    return spark.createDataFrame([(n, k, None, "r", f, s, "2026-01-01", a, 9) for n, k, f, s, a in rows], INDEX)


def test_history_tells_what_comes_back_from_what_is_new(spark):
    table = index(spark, [(1, "a", "f", "LOW", 1), (2, "b", "f", "LOW", 1), (4, "a", "f", "LOW", 1), (4, "b", "f", "LOW", 0), (5, "b", "g", "high", 1), (5, "b", "g", "high", 1), (5, None, "f", "LOW", 1)])
    assert {(r.snapshot_no, r.finding_key, r.status) for r in state.lifecycle(table).collect()} == {
        (1, "a", "NEW"), (2, "a", "RESOLVED"), (2, "b", "NEW"), (4, "a", "REOPENED"), (4, "b", "RESOLVED"), (5, "a", "RESOLVED"), (5, "b", "REOPENED"),
    }
    assert {(r.snapshot_no, r.finding_key, r.change) for r in state.snapshot_diff(table).collect()} == {
        (2, "a", "removed"), (2, "b", "added"), (4, "a", "added"), (4, "b", "same"), (5, "a", "removed"), (5, "b", "changed"),
    }
    assert {(r.snapshot_no, r.status) for r in state.fix_check(table).collect()} == {(2, "VERIFIED_BY_RESCAN"), (4, "VERIFIED_BY_RESCAN"), (5, "REGRESSION_DETECTED")}
    assert state.lifecycle(table.limit(0)).count() == state.fix_check(table.limit(0)).count() == state.snapshot_diff(table.limit(0)).count() == 0


def test_feedback_cascade(spark):
    rows = [("A ", None, "r", "sql"), (None, "b", "r", "sql"), ("z", None, "r", "sql"), ("y", None, "r", "x"), ("w", None, None, None)]
    table = scan(spark, *({"finding_no": i, "semantic_fingerprint": s, "fingerprint": f, "rule_id": r, "sink_kind": k} for i, (s, f, r, k) in enumerate(rows))).withColumn("ast_fingerprint", F.when(F.col("finding_no") == 3, "t"))
    said = [(1, "a", "q", "", "old", None), (2, "A", "q", "", "own", None), (3, "B", "q", "", "by print", None), (4, "", "r", "", "any", "t"), (5, None, "r", "sql", "there", None), (6, None, "r", "other", "elsewhere", "t")]
    entries = spark.createDataFrame(said, "entry_no int, semantic_fingerprint string, rule_id string, sink_kind string, verdict string, ast_fingerprint string")
    assert {(r.finding_no, r.weight, r.verdict) for r in state.feedback_match(table, entries).collect()} == {(0, 1.0, "own"), (1, 1.0, "by print"), (2, 0.7, "there"), (3, 0.95, "any")}


def test_baseline_by_either_key_and_what_is_gone(spark):
    table = scan(spark, {"finding_no": 1, "fingerprint": "F"}, {"finding_no": 2, "semantic_fingerprint": "s"}, {"finding_no": 3, "fingerprint": "n"}, {"finding_no": 4})
    base = spark.createDataFrame([("f", "x"), (None, "S "), ("g", "h"), (None, None)], "fingerprint string, semantic_fingerprint string")
    got = {(r.finding_no, r.finding_key, r.status) for r in state.baseline_status(table, base).collect()}
    assert got == {(1, "f", "EXISTING"), (2, "s", "EXISTING"), (3, "n", "NEW"), (4, None, "NEW"), (None, "h", "RESOLVED")}


def test_summaries(spark):
    from tracebed.operators import summary

    table = scan(
        spark,
        {"finding_no": 1, "category": "security", "cwe": ["CWE-601", "89"], "severity": "HIGH", "confidence": "HIGH", "message": "m" * 120},
        {"finding_no": 2, "category": "secret", "cwe": ["CWE-89"], "severity": "CRITICAL", "confidence": "low", "file": "a", "start_line": 3, "rule_id": "*" * 30},
        {"finding_no": 3, "category": "code_smell", "severity": "MEDIUM", "suppressed": True},
        {"finding_no": 4, "category": "security", "cwe": ["CWE-798"], "severity": "MEDIUM", "file": "b"},
        {"finding_no": 5},
    )
    assert {(r.name, r.n, r.pct) for r in summary.class_distribution(table).collect()} == {("Injection", 1, 25.0), ("Secrets", 2, 50.0), ("Configuration", 1, 25.0)}
    shown = {r.finding_no: (r.status, r.title) for r in summary.display(table).collect()}
    assert shown[1] == ("Needs Review", "m" * 97 + "...") and shown[2] == ("Potential Finding", "*" * 12) and shown[3][0] == "Suppressed" and shown[5][1] == "Finding"
    assert {(r.finding_no, r.bucket, r.complexity) for r in summary.remediation(table).collect()} == {(1, "immediate", "High"), (2, "immediate", "Low"), (4, "short_term", "Medium"), (5, "planned", "Medium")}
    assert [(r.finding_no, r.place) for r in summary.quick_wins(table).collect()] == [(2, "a:3"), (4, "b:0")]
    assert summary.exposure(table).first().n == 4


@pytest.mark.parametrize("glob,yes,no", [("*.py", "a/b.py", "a.pyc"), ("a?c", "abc", "ac"), ("[ab]x", "bx", "cx"), ("[!ab]x", "cx", "ax"), ("a.b", "a.b", "axb")])
def test_globs(glob, yes, no):
    import re

    assert re.search(findings.glob_regex(glob), yes) and not re.search(findings.glob_regex(glob), no)


def test_flow_query_is_three_valued(spark):
    rows = [{"finding_no": i, "tool": "semantic", "authentication_required": a, "internet_exposed": x} for i, (a, x) in enumerate([(None, None), (True, True), (False, False)])]
    table = scan(spark, *rows)
    match = lambda **q: {r.finding_no for r in flows.flow_matches(table, [flows.FlowQuery("q", **q)]).collect()}
    assert match(login=False) == {0, 2} and match(login=True) == {1} and match(exposed=False) == {2} and match(least_score=1.0) == set()


def test_versions(spark):
    used = spark.createDataFrame([("npm", "A", v) for v in ("1.9", "1.10", "2.0", "0.1", None)], "ecosystem string, package string, version string")
    told = spark.createDataFrame([("x", "NPM", "a", "1.10", "2.0", None), ("y", "npm", "a", None, None, ["0.1"])], "id string, ecosystem string, package string, introduced string, fixed string, versions array<string>")
    assert {(r.version, r.advisory) for r in packages.affected_packages(used, told).collect()} == {("1.10", "x"), ("0.1", "y")}


FILES = "file_no bigint, path string, lines array<string>, indexed_at timestamp_ntz, line string"


def test_code_operators_on_dirty_files(spark):
    files = spark.createDataFrame([(1, "a.py", ["try:", None, "x = {", "{", "}}", ""], None, "clash"), (1, "a.py", ["try:", None, "x = {", "{", "}}", ""], None, "clash"), (2, "b", None, None, ""), (None, "c.go", ["x"], None, "")], FILES)
    assert {(r.language, r.files, r.n_lines) for r in code.language_share(files).collect()} == {("python", 1, 6), ("other", 1, 1)}
    assert {(r.file_no, r.depth) for r in code.nesting(files).collect()} == {(1, 2)}
    rule = code.LineRule("r", contains="{", after="^try", unless=("import",))
    assert [(r.file_no, r.line_no) for r in code.rule_matches(files, [rule]).orderBy("line_no").collect()] == [(1, 3), (1, 4)]
    assert code.rule_matches(files, [code.LineRule("r", contains="{", needs=("zzz",))]).count() == 0
    assert code.rule_matches(files.limit(0), [rule]).count() == 0
    places = spark.createDataFrame([(1, 1), (9, 1), (None, 1)], "file_no bigint, line_no int")
    assert [r.snippet for r in code.snippet_context(places, files).collect()] == ["1: try:\n3: x = {"]


def test_regions_merge_when_they_touch(spark):
    rows = [("h", 1, 1, 6), ("h", 2, 1, 6), ("g", 1, 7, 12), ("g", 2, 20, 25), ("solo", 1, 50, 55), (None, 1, 1, 99)]
    blocks = spark.createDataFrame(rows + rows, "block_hash string, file_no bigint, start_line int, end_line int")
    assert {(r.file_no, r.start_line, r.end_line) for r in duplicates.duplicate_regions(blocks).collect()} == {(1, 1, 12), (2, 1, 6), (2, 20, 25)}


def test_near_pairs_count_lines_that_most_files_hold(spark):
    import random

    rng = random.Random(4)
    # three lines stand in all of 230 files, a third of which are copies of one
    sets = {i: {"h1", "h2", "h3"} | ({"c1", "c2"} if i % 3 == 0 else {f"{rng.randint(1, 40)}" for _ in range(rng.choice([0, 2, 4, 9, 14]))}) for i in range(230)}
    rows = [(i, n, t.upper()) for i, s in sets.items() for n, t in enumerate(sorted(s))]
    table = spark.createDataFrame(rows + rows[:50] + [(None, 1, "H1"), (500, 1, None)], "file_no bigint, line_no int, token_hash string")
    want = {(a, b, n, round(n / min(len(sets[a]), len(sets[b])), 6)) for a in sets for b in sets if a < b for n in [len(sets[a] & sets[b])] if round(n / min(len(sets[a]), len(sets[b])), 6) >= 0.3}
    got = [tuple(r) for r in duplicates.near_file_pairs(table).select("a", "b", "shared", "overlap").collect()]
    assert len(got) == len(want) and set(got) == want
    assert duplicates.near_file_pairs(table.limit(0)).count() == 0


def test_reached_files_end_on_circles(spark):
    import random

    def reached(rows, seeds):
        deps = spark.createDataFrame(rows, "file string, depends_on string")
        got = [(r.file, r.distance) for r in state.reached_files(deps, spark.createDataFrame([(s,) for s in seeds], "file string")).collect()]
        assert len(got) == len({f for f, _ in got})
        return dict(got)

    def brute(rows, seeds):
        out = dict.fromkeys({x for r in rows for x in r} & set(seeds), 0)
        front, n = set(out), 0
        while front:
            n += 1
            front = {f for f, on in rows if on in front} - set(out)
            out |= dict.fromkeys(front, n)
        return out

    assert reached([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "z")], ["c", "nowhere"]) == {"c": 0, "b": 1, "a": 2, "d": 3}
    rng = random.Random(6)
    rows = [(f"f{i}", f"f{rng.randint(max(0, i - 5), i + 1)}") for i in range(150)] + [(f"f{rng.randrange(150)}", f"f{rng.randrange(150)}") for _ in range(12)] + [(f"c{i}", f"c{i + 1}") for i in range(60)]
    rows = [r for r in rows if r[0] != r[1]]
    assert reached(rows, ["f3", "f70", "c60", "c20"]) == brute(rows, ["f3", "f70", "c60", "c20"])


def test_reports_of_tools(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
        return str(tmp_path / name)

    got = reports.pattern_report(spark, put("a.json", {"results": [{"check_id": "c", "path": "p", "start": {"line": 1}, "end": {"line": 2}, "extra": {"message": "m", "severity": "ERROR"}}], "errors": []})).first()
    assert (got.rule_id, got.severity, got.end_line) == ("c", "HIGH", 2)
    got = reports.python_report(spark, put("b.json", {"results": [{"test_id": "B1", "issue_severity": "low", "filename": "f", "line_number": 3, "line_range": [3, 5]}]})).first()
    assert (got.rule_id, got.severity, got.end_line) == ("B1", "LOW", 5)
    got = reports.go_report(spark, put("c.json", {"Issues": [{"rule_id": "G1", "severity": "HIGH", "details": "d", "file": "f", "line": "4-6"}]})).first()
    assert (got.start_line, got.end_line) == (4, 6)
    assert reports.lint_report(spark, put("d.json", [{"code": "E1", "message": "m", "filename": "f", "location": {"row": 1}, "end_location": {"row": 1}}])).first().rule_id == "E1"
    assert reports.secret_report(spark, put("e.json", [{"RuleID": "k", "File": "f", "StartLine": 1, "EndLine": 1, "Secret": "never read"}])).columns == ["tool", "rule_id", "severity", "file", "start_line", "end_line", "message"]
    assert [(r.file, r.start_line, r.message) for r in reports.text_report(spark, put("f.txt", "a.go:3:2: bad thing\nnoise\n")).collect()] == [("a.go", 3, "bad thing")]


def test_source_tree(spark, tmp_path):
    (tmp_path / "a.py").write_bytes("﻿x = 1\ny\n".encode())
    (tmp_path / "b.go").write_bytes("ä\n".encode("utf-16"))
    (tmp_path / "c.py").write_bytes(b"\x00\x01")
    (tmp_path / "d.min.js").write_text("x")
    got = {r.path.rsplit("/", 1)[1]: (r.language, r.lines) for r in reports.source_tree(spark, str(tmp_path)).collect()}
    assert got["a.py"] == ("python", ["x = 1", "y"]) and got["b.go"][0] == "go" and set(got) == {"a.py", "b.go"}


def test_lifecycle_stream(spark, tmp_path):
    from tracebed.streaming.lifecycle import lifecycle_stream

    schema = "finding_key string, seq long, active boolean"
    batches = [[("a", 1, True), ("b", 1, True)], [("a", 2, False), ("b", 2, True), ("b", 2, True)], [("a", 3, True), ("b", 1, False), (None, 3, True)]]
    source, out = tmp_path / "in", []
    source.mkdir()
    stream = lifecycle_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        q = stream.writeStream.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(out) == [("a", 1, "NEW"), ("a", 2, "RESOLVED"), ("a", 3, "REOPENED"), ("b", 1, "NEW"), ("b", 2, "EXISTING")]


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    from types import SimpleNamespace

    from tracebed.session import shared_folder

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda *a: None)))
    with pytest.raises(ValueError):
        shared_folder(bare)

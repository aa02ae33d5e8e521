"""Linked and merged findings against brute force; components against union-find."""

import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest

from tracebed.operators import components, correlation

SCHEMA = (
    "finding_no bigint, file string, start_line int, end_line int, cwe array<string>, category string, normalized_type string, rule_id string, source_kind string, sink_kind string, code_snippet string, fingerprint string, "
    "semantic_fingerprint string, severity string, tool string, detected_by array<string>, message string, reachable boolean, exploitability_score double, confidence_score double, correlation_score double, name string, rep bigint"
)


def row(no, **k):
    base = dict(file="src/a.py", start_line=10, end_line=10, cwe=["CWE-1"], category="security", normalized_type="sql-injection", rule_id="r", source_kind="", sink_kind="", code_snippet=f"{no}: x{no}", fingerprint=f"f{no}", semantic_fingerprint=f"s{no}")
    rest = dict(severity="LOW", tool=f"t{no % 3}", detected_by=None, message="m" * (no % 7), reachable=None, exploitability_score=None, confidence_score=None, correlation_score=None, name="clash", rep=1)
    return tuple({"finding_no": no, **base, **rest, **k}.values())


def brute_links(rows):
    """Score of each two findings that are linked by place and kind, by Python's own matcher."""
    out = {}
    for a, b in combinations(sorted(rows), 2):
        (x, fx, sx, ex, cx, gx, tx, _, ox, kx, *_), (y, fy, sy, ey, cy, gy, ty, _, oy, ky, *_) = a, b
        one, two = set(cx or []), set(cy or [])
        if (fx or "").lower() != (fy or "").lower() or not one & two:
            continue
        lo, hi, la, ha = max(1, sx or 1), max(1, sx or 1, ex or 1), max(1, sy or 1), max(1, sy or 1, ey or 1)
        if (lo, hi, gx) == (la, ha, gy):
            out[x, y] = 0.96
            continue
        over = min(hi, ha) - max(lo, la) + 1
        place = over / (max(hi, ha) - min(lo, la) + 1) if over > 0 else 0.5 if 1 - over <= 2 else 0
        score = 0.28 * place + 0.22 * len(one & two) / len(one | two) + 0.08 * bool(ox and ox == oy) + 0.08 * bool(kx and kx == ky) + 0.22 * SequenceMatcher(None, tx, ty).ratio()
        if round(score, 6) >= 0.72:
            out[x, y] = round(score, 6)
    return out


def group_of(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def random_rows(seed, n):
    r = random.Random(seed)
    out = []
    for no in range(1, n + 1):
        start = r.choice([None, 1, 5, r.randint(1, 60), r.randint(1, 60)])
        end = None if r.random() < 0.1 else (start or 1) + r.choice([0, 0, 1, 3, 8, 40, 200])
        kinds = ["sql-injection", "sql injection", "sqli", "injection.sql", "path-traversal"]
        out.append(row(no, file=r.choice(["src/a.py", "SRC/a.py", "src/b.py", None, ""]), start_line=start, end_line=end, cwe=r.choice([["CWE-1"], ["CWE-1"], ["CWE-1", "CWE-2"], ["CWE-2", "CWE-3"], [], None]), category=r.choice(["security", "bug"]), normalized_type=r.choice(kinds), source_kind=r.choice(["web", "web", "", None]), sink_kind=r.choice(["db", "db", ""]), fingerprint=r.choice([f"F{r.randint(1, n)} ", f"f{no}"]), severity=r.choice(["LOW", "high", "MEDIUM"])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_groups_equal_brute_force(spark, seed):
    rows = random_rows(seed, 220)
    want = brute_links(rows)
    scan = spark.createDataFrame(rows + rows[:9], SCHEMA)
    # classes alike in all that is compared stand for their findings
    key = lambda r: ((r[1] or "").lower(), max(1, r[2] or 1), max(1, r[2] or 1, r[3] or 1), tuple(sorted(set(r[4] or []))), r[5], r[6], r[8] or "", r[9] or "")
    rep = {}
    for r in sorted(rows):
        rep.setdefault(key(r), r[0])
    reps = set(rep.values())
    assert len(want) > 50
    got = {(r.a, r.b): r.score for r in correlation.correlated_links(scan).collect()}
    assert got == {k: v for k, v in want.items() if set(k) <= reps}

    by_fp = {}
    for r in rows:
        by_fp.setdefault(r[11].strip().lower(), []).append(r[0])
    edges = [*want, *((v[0], x) for v in by_fp.values() for x in v[1:])]
    groups = group_of([r[0] for r in rows], edges)
    sizes = {}
    for g in groups.values():
        sizes[g] = sizes.get(g, 0) + 1
    merged = {r.group_no: r for r in correlation.correlated_findings(scan).collect()}
    assert {g: m.n for g, m in merged.items()} == sizes
    rank = {"high": 1, "MEDIUM": 2, "LOW": 3}
    best = {}
    for r in rows:
        g = groups[r[0]]
        best[g] = min(best.get(g, (9, 0)), (rank[r[13]], r[0]))
    assert {g: m.finding_no for g, m in merged.items()} == {g: b[1] for g, b in best.items()}


def test_merging_fills_and_unites(spark):
    rows = [
        row(1, severity="LOW", tool="one", message="longer text", reachable=True, confidence_score=0.4, code_snippet=None),
        row(2, start_line=10, end_line=10, severity="HIGH", tool="two", detected_by=["two", "three", "two"], message="text", cwe=["CWE-1", "CWE-9"], confidence_score=0.9, code_snippet=" "),
        row(3, severity="LOW", tool="four", code_snippet="3: x"),
        row(4, start_line=500, cwe=None, fingerprint=None, semantic_fingerprint="", code_snippet=None, normalized_type=None, rule_id=None),
        row(5, start_line=500, cwe=None, fingerprint=None, semantic_fingerprint=None, code_snippet=None, normalized_type=None, rule_id=None),
        row(6, start_line=500, cwe=None, code_snippet=None),
    ]
    got = {r.group_no: r for r in correlation.correlated_findings(spark.createDataFrame(rows, SCHEMA)).collect()}
    one = got[1]
    assert (one.finding_no, one.n, one.engines, one.cwes) == (2, 3, "four,one,three,two", "CWE-1,CWE-9")
    assert (one.snippet_from, one.message_from, one.reachable, one.confidence_score, one.correlation_score) == (3, 1, True, 0.9, 0.96)
    # without weaknesses only equal identities link, computed ones included
    assert (got[4].n, got[4].correlation_score, got[6].n, got[6].correlation_score) == (2, 1.0, 1, 0.0)


def test_empty_table(spark):
    scan = spark.createDataFrame([], SCHEMA)
    assert correlation.correlated_links(scan).collect() == [] and correlation.correlated_findings(scan).collect() == []


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 50)] + [(60, 49)], [(7, 7), (3, 2), (2, 3), (9, 8)], []])
def test_components(spark, edges):
    df = spark.createDataFrame([(*e, 0) for e in edges] + [(None, 1, 0)], "a bigint, b bigint, node int")
    got = {r.node: r.component for r in components.connected(df).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == group_of(nodes, [e for e in edges if e[0] != e[1]])

"""Duplicate findings: groups of near blocks against a brute force over places."""

import random
from itertools import combinations

import pytest

from tracebed.operators import duplicates

SCHEMA = "file_no bigint, start_line int, end_line int, token_hashes array<string>, name string, component bigint, n int"


def brute(rows):
    places = sorted({(f, s, e, tuple(sorted({t.strip().lower() for t in ts if t}))) for f, s, e, ts, *_ in rows})
    sets = sorted({p[3] for p in places if p[3]})
    apart = lambda p, q: p[0] != q[0] or p[2] < q[1] or q[2] < p[1]
    of = {w: [p for p in places if p[3] == w] for w in sets}
    root = {}

    def find(w):
        while root.get(w, w) != w:
            w = root[w]
        return w

    linked = set()
    for a, b in [*combinations(sets, 2), *((w, w) for w in sets)]:
        if len(set(a) & set(b)) >= 0.7 * max(len(a), len(b)) - 1e-9 and any(apart(p, q) for p in of[a] for q in of[b]):
            linked |= {a, b}
            if find(a) != find(b):
                root[find(a)] = find(b)
    groups = {}
    for w in linked:
        groups.setdefault(find(w), []).extend(p[:3] for p in of[w])
    told = []
    for g in groups.values():
        g, lines = sorted(g), sum(e - s + 1 for _, s, e in g)
        severity = "HIGH" if len(g) >= 5 or lines >= 80 else "MEDIUM" if len(g) >= 3 or lines >= 40 else "LOW"
        told += [[*p, severity, len(g), *g[0][:2]] for p in g[1:]]
    out = []
    for t in sorted(told):
        if out and out[-1][0] == t[0] and t[1] <= out[-1][2] + 1:
            out[-1][2] = max(out[-1][2], t[2])
        else:
            out.append(t)
    return sorted(map(tuple, out))


def random_blocks(seed):
    """Windows of six lines over files made of few kinds of lines, one file copied many times."""
    r = random.Random(seed)
    texts = [[r.choice("abcdefghijklmnop") + r.choice("12345678") for _ in range(r.randint(3, 30))] for _ in range(8)]
    texts += [texts[0]] * 6 + [texts[1][:9] + ["new"] + texts[1][9:]] + [["x1"] * 20]
    return [(f, i + 1, i + 6, t[i : i + 6], "clash", 1, 1) for f, t in enumerate(texts) for i in range(len(t) - 5)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = random_blocks(seed)
    got = sorted(map(tuple, duplicates.duplicate_findings(spark.createDataFrame(rows + rows[:5], SCHEMA)).collect()))
    assert got == brute(rows) and got


def test_dirty_rows(spark):
    rows = [(1, 1, 6, ["A ", "b", None, ""], "", 0, 0), (2, 4, 9, ["a", "B"], "", 0, 0), (None, 1, 6, ["a", "b"], "", 0, 0), (3, None, 6, ["a", "b"], "", 0, 0), (4, 1, 6, None, "", 0, 0), (5, 1, 6, [], "", 0, 0), (6, 1, None, ["c"], "", 0, 0), (6, 1, 1, ["c"], "", 0, 0)]
    assert list(map(tuple, duplicates.duplicate_findings(spark.createDataFrame(rows, SCHEMA)).collect())) == [(2, 4, 9, "LOW", 2, 1, 1)]
    assert duplicates.duplicate_findings(spark.createDataFrame([], SCHEMA)).collect() == []

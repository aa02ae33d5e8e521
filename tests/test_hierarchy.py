import datetime as dt
import random

import pytest

from tracebed.operators.hierarchy import dependency_hierarchy, dependents, solve_forest
from tracebed.session import Scratch

SCHEMA = "file string, depends_on string, recorded_at timestamp_ntz, root string, id int"


def at(day):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=day)


def table(spark, rows):
    return spark.createDataFrame([(a, b, t, "clash", 1) for a, b, t in rows], SCHEMA)


def brute(rows):
    parent, names = {}, set()
    for a, b, t in rows:
        names |= {x for x in (a, b) if x}
        if a and a != b:
            parent.setdefault(a, []).append((t or dt.datetime.min, b or ""))
    parent = {a: max(v)[1] or None for a, v in parent.items()}
    out, below = {}, dict.fromkeys(names, 0)
    for f in names:
        path, x = [], f
        while x is not None and x not in path:
            path.append(x)
            x = parent.get(x)
        if x is None:
            out[f] = (path[-1], len(path) - 1)
            for y in path[1:]:
                below[y] += 1
        else:
            out[f] = ("", -1 if x == f else -2)
    return {f: (r, d, below[f] if d >= 0 else -1) for f, (r, d) in out.items()}


def solved(spark, rows, every=16):
    return {r.file: (r.root, r.depth, r.n_descendants) for r in dependency_hierarchy(table(spark, rows), splitter_every=every).collect()}


def test_paths_and_latest_row(spark):
    rows = [(" a/./b ", "a//c", at(1)), ("a/b", "d", at(0)), ("a\\c", "x/../e", at(2)), ("e", "", at(1)), ("e", "a/b", at(0)), ("q", "q", at(0)), (None, "z", at(0)), ("n", None, None)]
    assert solved(spark, rows) == {"a/b": ("e", 2, 0), "a/c": ("e", 1, 1), "d": ("d", 0, 0), "e": ("e", 0, 2), "q": ("q", 0, 0), "z": ("z", 0, 0), "n": ("n", 0, 0)}


@pytest.mark.parametrize("every", [1, 2, 7, 10_000])
def test_random_graphs_with_circles(spark, every):
    rng = random.Random(every)
    names = [f"f{i}" for i in range(140)]
    rows = [(f, rng.choice(names[max(0, i - 12) : i + (4 if i % 9 == 0 else 0)] or [None]), at(0)) for i, f in enumerate(names)]
    assert solved(spark, rows, every) == brute(rows)


def test_long_chain_and_long_circle(spark):
    chain = [(f"c{i}", f"c{i + 1}", at(0)) for i in range(300)]
    circle = [(f"o{i}", f"o{(i + 1) % 90}", at(0)) for i in range(90)] + [("t1", "t2", at(0)), ("t2", "o5", at(0))]
    assert solved(spark, chain + circle, 8) == brute(chain + circle)


def test_paths_and_dependents(spark):
    rows = [("a", "b", at(0)), ("b", "c", at(0)), ("x", "y", at(0)), ("y", "x", at(0))]
    got = {r.file: r.path for r in dependency_hierarchy(table(spark, rows), with_paths=True, splitter_every=2).collect()}
    assert got == {"a": ["a", "b", "c"], "b": ["b", "c"], "c": ["c"], "x": None, "y": None}
    assert {(r.file, r.dependent, r.distance) for r in dependents(table(spark, rows)).collect()} == {("b", "a", 1), ("c", "a", 2), ("c", "b", 1)}


def test_empty(spark):
    assert solved(spark, []) == {}
    nodes = spark.createDataFrame([], "id bigint, parent bigint, splitter_hash bigint")
    assert solve_forest(nodes, Scratch(spark, "t"), with_paths=True).collect() == []

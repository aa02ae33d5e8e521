import random

import pytest

from tracebed.llm import spans
from tracebed.llm.spans import shared_lines, shared_share, shared_spans

SCHEMA = "file_no bigint, line_no int, token_hash string, pos string, token int"


def table(spark, files):
    """files: number -> tokens, each on the next line but one."""
    rows = [(f, 2 * i + 1, t, "clash", 0) for f, tokens in files.items() for i, t in enumerate(tokens)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(files, k):
    grams = {}
    for f, t in files.items():
        for i in range(len(t) - k + 1):
            g = tuple(t[i : i + k])
            if None not in g:
                grams.setdefault(tuple(x.lower() for x in g), []).append((f, i))
    return {(f, 2 * (i + j) + 1) for places in grams.values() if len({f for f, _ in places}) > 1 for f, i in places for j in range(k)}


def found(df, k):
    rows = shared_lines(df, k).collect()
    assert len({tuple(r) for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("alphabet,k,block", [(2, 4, 4096), (4, 5, 16), (40, 3, 7), (1, 3, 16)])
def test_random_files(spark, monkeypatch, alphabet, k, block):
    monkeypatch.setattr(spans, "BLOCK", block)
    rng = random.Random(alphabet)
    files = {f: [f"T{rng.randrange(alphabet)}" for _ in range(rng.randint(0, 45))] for f in range(9)}
    files[9] = files[1][3:30] + [None] + files[2][:20]
    df = table(spark, files)
    assert found(df, k) == brute(files, k)


def test_case_repeats_and_own_copies(spark):
    run = [f"a{i}" for i in range(10)]
    own = [f"b{i}" for i in range(10)]
    files = {1: run + ["x"], 2: ["y"] + [t.upper() for t in run], 3: own + own, 4: run[:9]}
    df = table(spark, files)
    df = df.unionByName(df).unionByName(spark.createDataFrame([(None, 1, "a", "", 0), (1, None, "a", "", 0)], SCHEMA))
    assert found(df, 10) == brute(files, 10) == {(1, 2 * i + 1) for i in range(10)} | {(2, 2 * i + 3) for i in range(10)}
    share = {r.file_no: (r.n_lines, r.n_shared, r.share) for r in shared_share(df, 10).collect()}
    assert share[1] == (11, 10, round(10 / 11, 6)) and share[4] == (9, 0, 0.0)


def test_unitigs_compact_a_long_run(spark):
    run = [f"r{i}" for i in range(60)]
    rows = shared_spans(table(spark, {1: run, 2: ["q"] + run}), 10).collect()
    assert {(r.file_no, r.start_pos, r.n_rows) for r in rows} == {(1, 0, 60), (2, 1, 60)}
    assert len({(r.unitig, r.unitig_offset) for r in rows}) == 1


def test_empty(spark):
    df = table(spark, {})
    assert found(df, 10) == set() and shared_share(df).count() == 0

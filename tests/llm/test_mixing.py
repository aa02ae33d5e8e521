import pytest

from tracebed.llm.mixing import copy_rates, mixture, mixture_shares

DOCS = "doc_id bigint, text string, source string, rate double"
TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, sizes):
    rows, n = [], 0
    for source, lengths in sizes.items():
        for k in lengths:
            rows.append((n, " word" * k, source, 0.5))
            n += 1
    return spark.createDataFrame(rows, DOCS)


def test_shares_caps_and_size(spark):
    table = docs(spark, {"a": [50] * 40, " A ": [50] * 10, "b-x": [20] * 50, "c": [10] * 10, "other": [99], None: [5]})
    targets = spark.createDataFrame([("a", 0.3, 1), ("b_x", 0.4, 2), ("C", 0.3, 3)], TARGETS)
    got = {r.source: r for r in mixture_shares(table, targets).collect()}
    assert set(got) == {"a", "b_x", "c"}
    total = 50 * 50 + 20 * 50 + 100
    # c is full at 300, b_x at 2000: a takes the rest
    assert got["c"].tokens == 300 and got["c"].max_copies == 3
    assert abs(got["a"].tokens + got["b_x"].tokens + got["c"].tokens - total) <= 100
    assert all(r.max_copies <= {"a": 1, "b_x": 2, "c": 3}[r.source] for r in got.values())
    ratio = got["a"].tokens / got["b_x"].tokens
    assert ratio == pytest.approx(0.3 / 0.4, rel=0.05)
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1, abs=1e-5)


def test_rates_when_all_are_full(spark):
    sizes = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], TARGETS)
    assert {r.source: r.rate for r in copy_rates(sizes, targets).collect()} == {"a": 1.0, "b": 1.0}


def test_copies_follow_systematic_sampling(spark):
    table = docs(spark, {"a": range(1, 120), "b": [30] * 100})
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 2)], TARGETS)
    rows = mixture(table, targets).collect()
    rates = {}
    for s in "ab":
        mine = [r for r in rows if r.source == s]
        assert len({(r.doc_id, r.copy_no) for r in mine}) == len(mine)
        rates[s] = mine
    share = sum(r.n_tokens for r in rates["a"]) / sum(r.n_tokens for r in rows)
    assert share == pytest.approx(0.5, abs=0.02)
    assert {tuple(r) for r in mixture(table, targets).collect()} == {tuple(r) for r in rows}
    assert {tuple(r) for r in mixture(table, targets, seed=8).collect()} != {tuple(r) for r in rows}


def test_dirty_and_empty(spark):
    rows = [(1, None, "a", 0.0), (1, None, "a", 0.0), (2, "", "a", 0.0), (3, "x y", "a", 0.0), (None, "x", "a", 0.0), (4, "z", None, 0.0)]
    table = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 1.0, 2), ("gone", 0.5, 2), (None, 0.5, 1), ("a", None, 1)], TARGETS)
    assert {r.doc_id for r in mixture(table, targets).collect()} == {1, 2, 3}
    assert mixture(table.limit(0), targets).count() == 0 and mixture(table, targets.limit(0)).count() == 0
    assert mixture_shares(table.limit(0), targets).count() == 0


def test_running_sums_are_exact_where_doubles_end(spark):
    from tracebed.llm.mixing import _copies
    from tracebed.session import Scratch

    # a goal of 2**53 + 1 tokens of as many: each document once, whatever the offset
    big = 2**53 + 1
    sized = spark.createDataFrame([(i, "a", 1) for i in range(50)], "doc_id bigint, source string, n_tokens bigint")
    rates = spark.createDataFrame([("a", big, big)], "source string, goal bigint, own_tokens bigint")
    assert sorted(r.doc_id for r in _copies(sized, rates, 7, Scratch(spark, "t")).collect()) == list(range(50))

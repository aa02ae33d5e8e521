import random

from tracebed.operators.snapshots import finding_changes

SCHEMA = "snapshot_no int, semantic_fingerprint string, fingerprint string, rule_id string, file string, severity string, last_seen string, active int, key string, snap int"


def row(no, sem, fp="f", rule="r", file="x", sev="HIGH", seen="2026-01-01 00:00:00", active=1):
    return (no, sem, fp, rule, file, sev, seen, active, "clash", 0)


def changes(spark, rows):
    got = finding_changes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({(r.snapshot_no, r.finding_key) for r in got}) == len(got)
    return {(r.snapshot_no, r.finding_key, r.change_kind) for r in got}


def test_added_removed_changed_and_gap(spark):
    rows = [row(1, "a"), row(1, "b"), row(2, "a", sev="low"), row(4, "a", sev=" LOW "), row(4, "b"), row(4, "c", active=0)]
    assert changes(spark, rows) == {(2, "a", "changed"), (2, "b", "removed"), (4, "b", "added"), (4, "c", "added")}


def test_latest_row_counts_whatever_its_spelling(spark):
    rows = [row(1, "a", rule="old", seen="2026-01-01T00:00:00Z"), row(1, "a", rule="new", seen="2026-01-02 00:00:00.000"), row(2, "a", rule="new"), row(2, "a", rule="bad", seen="never")]
    assert changes(spark, rows) == set()


def test_dirty_rows(spark):
    rows = [row(1, None), row(1, None), row(1, " "), row(2, "", fp="f"), row(2, None, fp=None), row(None, "z"), row(2, "q", fp=None, file=""), row(3, "q", fp="", file=None), row(3, " ", fp="f ")]
    assert changes(spark, rows) == {(2, "q", "added")}


def test_one_snapshot_and_empty_table(spark):
    assert changes(spark, [row(1, "a")]) == set()
    assert changes(spark, []) == set()


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [row(rng.choice([1, 2, 3, 5, 8]), rng.choice("abcdefgh"), rule=rng.choice(["r", "s"]), seen=f"2026-01-{rng.randint(1, 28):02d} 00:00:{i % 60:02d}", active=rng.choice([0, 1])) for i in range(160)]
    state = {}
    for r in sorted(rows, key=lambda r: r[6]):
        state.setdefault(r[0], {})[r[1]] = (r[3], r[7])
    want, order = set(), sorted(state)
    for a, b in zip(order, order[1:]):
        for k in {*state[a], *state[b]}:
            if k not in state[a]:
                want.add((b, k, "added"))
            elif k not in state[b]:
                want.add((b, k, "removed"))
            elif state[a][k] != state[b][k]:
                want.add((b, k, "changed"))
    assert changes(spark, rows) == want

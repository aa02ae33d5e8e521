import datetime as dt
import random

import pytest

from tracebed.llm import batches
from tracebed.llm.batches import AcceptedHistory, judge_run, prepare, repeated_findings, snippet_features, snippet_words
from tracebed.session import Scratch

SCAN = "finding_no bigint, batch_no int, batch_at timestamp_ntz, fingerprint string, semantic_fingerprint string, code_snippet string, rec string"
FINDINGS = "fingerprint string, semantic_fingerprint string, first_seen string, k int"


def when(batch):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=7 * (batch or 0))


def tables(spark, scan, findings=()):
    rows = [(no, batch, when(batch), fp, sem, code, "clash") for no, batch, fp, sem, code in scan]
    return spark.createDataFrame(rows, SCAN), spark.createDataFrame([(*f, 1) for f in findings], FINDINGS)


def brute(scan, findings=()):
    norm = lambda x: (x or "").strip(" ").lower() or None
    seen = {"f": {}, "s": {}}
    for f, s, t in findings:
        try:
            t = dt.datetime.fromisoformat(t.replace("Z", ""))
        except (ValueError, AttributeError):
            continue
        for kind, v in (("f", norm(f)), ("s", norm(s))):
            if v:
                seen[kind][v] = min(t, seen[kind].get(v, t))
    found, fs, ss, sets = set(), set(), set(), []
    for no, batch, f, s, code in sorted(set(scan), key=lambda r: r[0]):
        f, s, words = norm(f), norm(s), snippet_words(code)
        known = any(v and seen[k].get(v, dt.datetime.max) < when(batch) for k, v in (("f", f), ("s", s)))
        like = len(words) >= 10 and any(len(words & w) / len(words | w) >= 0.7 for w in sets)
        if known or (f and f in fs) or (s and s in ss) or like:
            found.add(no)
            continue
        fs.add(f), ss.add(s)
        if len(words) >= 10:
            sets.append(words)
    return found


def found(spark, scan, findings=()):
    rows = repeated_findings(*tables(spark, scan, findings)).collect()
    assert len({r.finding_no for r in rows}) == len(rows)
    return {r.finding_no for r in rows}


def snippets(rng, n, base=12, words=34):
    pool = [f"{a}_{b}_{rng.randint(1, 99)}" for a in ("resolve", "emit", "channel", "harvest") for b in ("timber", "lagoon", "orchard", "pylon", "walnut") for _ in range(12)]
    bases = [rng.sample(pool, words) for _ in range(base)]
    out = []
    for _ in range(n):
        w = list(rng.choice(bases))
        for i in rng.sample(range(words), rng.choice([0, 0, 1, 2, 4, 9])):
            w[i] = rng.choice(pool)
        if rng.random() < 0.3:
            rng.shuffle(w)
        out.append("\n".join(f"{i}: {' '.join(w[i * 5 : i * 5 + 5])}" for i in range(7)))
    return out


def test_snippet_words():
    assert snippet_words(" 12: Foo_1(bar)\n13:foo_1 Ünï") == {"foo_1", "bar", "ünï"}
    assert snippet_words(None) == snippet_words("") == set()


def test_a_repeat_of_a_rejected_row_alone_is_accepted(spark):
    # 2 repeats 1 by fingerprint; 3 repeats only 2, by semantic fingerprint, so it stays
    scan = [(1, 1, "A", None, None), (2, 1, " a ", "s", None), (3, 1, None, "S", None), (4, 2, None, "s ", None), (5, 2, "", " ", "x"), (6, 2, "", None, "x")]
    assert found(spark, scan) == brute(scan) == {2, 4}


def test_index_known_before_the_batch(spark):
    findings = [("f1", None, "2026-01-07 00:00:00"), (None, "s1", "2026-01-08T00:00:01Z"), ("f2", "x", "soon"), ("f2", None, None)]
    scan = [(1, 1, "F1", None, None), (2, 1, None, "s1", None), (3, 2, None, "s1", None), (4, 2, "f2", None, None)]
    assert found(spark, scan, findings) == brute(scan, findings) == {1, 3}


def test_random_batches_against_brute_force(spark):
    rng = random.Random(11)
    codes = snippets(rng, 150)
    scan = [(i + 1, 1 + i // 50, rng.choice([None, f"f{rng.randint(0, 120)}"]), rng.choice([None, "", f"s{rng.randint(0, 200)}"]), rng.choice([codes[i], codes[i], None, "short one"])) for i in range(150)]
    scan += rng.sample(scan, 9)
    assert found(spark, scan) == brute(scan)


def test_hot_group_of_copies_and_near_copies(spark):
    rng = random.Random(5)
    one = snippets(rng, 60, base=1)
    scan = [(i + 1, 1 + i // 30, None, None, one[0] if i % 3 == 0 else one[i]) for i in range(60)]
    assert found(spark, scan) == brute(scan)


def test_a_later_session_opens_the_history_and_judges_one_more_batch(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    codes = snippets(rng, 90)
    scan = [(i + 1, 1 + i // 30, f"f{rng.randint(0, 70)}", None, codes[i]) for i in range(90)]
    early, late = tables(spark, scan[:60]), tables(spark, scan[60:])
    monkeypatch.setattr(batches, "RUN_ROWS", 0)
    repeats = {r.finding_no for r in repeated_findings(*early, path=str(tmp_path / "h")).collect()}
    history = AcceptedHistory.open(spark, str(tmp_path / "h"))
    assert len(history.runs) == 2
    # what a run that died has left behind is never read
    history.append(spark.createDataFrame([(b"x", 61)], "k binary, rec bigint"), "keys", 5)
    history.close()
    history = AcceptedHistory.open(spark, str(tmp_path / "h"))
    assert history.spoilt
    scratch = Scratch(spark, "t")
    rows, features, _ = prepare(*late, scratch, history.order)
    judge_run(rows, features, 3, 3, history, scratch)
    accepted = {r.rec for r in history.accepted().collect()}
    history.close()
    assert {r[0] for r in scan} - accepted == brute(scan) and repeats == {n for n in brute(scan) if n <= 60}


def test_history_is_not_shuffled(spark, tmp_path):
    codes = snippets(random.Random(2), 60)
    repeated_findings(*tables(spark, [(i + 1, 1, None, None, c) for i, c in enumerate(codes)]), path=str(tmp_path / "h")).count()
    history = AcceptedHistory.open(spark, str(tmp_path / "h"))
    scratch = Scratch(spark, "t")
    _, features, _ = prepare(*tables(spark, [(99, 2, None, None, codes[0])]), scratch, history.order)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (batches.covered(features, history), batches.uncovered_like(features, history)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            joins = [x for x in plan.splitlines() if "FileScan parquet" in x and history.name in x]
            assert len(joins) == 2 and all("Bucketed: true" in x for x in joins)
            assert [r.cls for r in found.collect()] == [snippet_features(codes[0])["cls"]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        history.close()


def test_coverage_decides_most_like_pairs_whose_words_keep_their_order():
    rng = random.Random(1)
    like = decided = 0
    for _ in range(400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(12, 200))]
        near = [w if rng.random() > 0.08 else f"v{rng.randrange(10**6)}" for w in base]
        a, b = snippet_words(" ".join(base)), snippet_words(" ".join(near))
        if a != b and len(a & b) / len(a | b) >= 0.7:
            x, y = (set(snippet_features(" ".join(t))["chunks"]) for t in (base, near))
            size = lambda c: sum(v & 0xFFFF for v in c)
            like, decided = like + 1, decided + (size(x & y) >= batches.MIN_COVERAGE * max(size(x), size(y)))
    assert like > 300 and decided / like >= 0.85


def test_empty_tables(spark):
    assert found(spark, []) == set()
    assert found(spark, [(None, 1, "a", "b", "c"), (1, None, None, None, None)]) == set()


@pytest.mark.parametrize("n", [10, 30, 200])
def test_leading_tokens(n):
    made = snippet_features(" ".join(f"w{i}" for i in range(n)))
    assert len(made["words"]) == n and len(batches.leading_words(made["words"])) == n - -(-7 * n // 10) + 1
    size = lambda c: sum(v & 0xFFFF for v in c)
    first = batches.leading_chunks(made["chunks"])
    rest = made["chunks"][len(first) :]
    assert 2 * size(rest) < size(made["chunks"]) <= 2 * size(rest + first[-1:])


def test_long_sets_of_short_words_with_few_long_ones(spark):
    # in another order of words no chunk is shared: the rarest words find these
    rng = random.Random(3)
    scan = []
    for _ in range(20):
        base = [f"v{rng.randrange(10**5)}" for _ in range(200)] + [f"announce_{rng.randrange(10**6):06d}" for _ in range(12)]
        near = [w if rng.random() < 0.86 else f"u{rng.randrange(10**5)}" for w in base]
        near = rng.sample(near, len(near)) if len(scan) % 4 else near
        scan += [(len(scan) + i + 1, 1 + i, None, None, " ".join(w)) for i, w in enumerate((base, near))]
    want = brute(scan)
    assert len(want) >= 10 and found(spark, scan) == want


def jobs_so_far(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def chain(n):
    """Rows of which each shares a fingerprint of one kind with the next and with no other."""
    return [(i + 1, 1, f"f{i // 2}", f"s{(i + 1) // 2}", None) for i in range(n)]


def test_jobs_of_the_driver_do_not_grow_with_a_chain_of_like_rows(spark):
    short, long = chain(4), chain(14)
    start = jobs_so_far(spark)
    assert found(spark, short) == brute(short) == {2, 4}
    middle = jobs_so_far(spark)
    assert found(spark, long) == brute(long) == set(range(2, 15, 2))
    assert jobs_so_far(spark) - middle <= middle - start + 5


def test_first_run_asks_no_history(spark, monkeypatch):
    codes = snippets(random.Random(4), 30)
    scan = [(i + 1, 1, None, None, c) for i, c in enumerate(codes)]
    for name in ("covered", "uncovered_like"):
        monkeypatch.setattr(batches, name, lambda *_: pytest.fail("an empty history was looked up"))
    assert found(spark, scan) == brute(scan)


def test_rounds_and_one_task_settle_alike(spark, monkeypatch):
    rng = random.Random(12)
    codes = snippets(rng, 80, base=4)
    scan = [(i + 1, 1 + i // 60, rng.choice([None, f"f{rng.randint(0, 40)}"]), rng.choice([None, f"s{rng.randint(0, 60)}"]), codes[i]) for i in range(80)]
    want = brute(scan)
    for most in (0, 60, 200_000):
        monkeypatch.setattr(batches, "SETTLE_ROWS", most)
        assert found(spark, scan) == want

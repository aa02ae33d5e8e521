"""Findings and files over time: diffs of snapshots, lifecycle, baselines, feedback, affected files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracebed.functions.text import blank_free, plain_path, present, utc_time
from tracebed.operators.findings import normal_findings
from tracebed.operators.hierarchy import _jump
from tracebed.session import Scratch


def finding_states(findings: DataFrame) -> DataFrame:
    """finding_key, snapshot_no, at, state, severity, active of all snapshots, at numbering those delivered 0, 1, ...

    Within a snapshot an identity's row with the latest last_seen counts, ties by the greater content.
    """
    key = F.coalesce(present(F.col("semantic_fingerprint")), present(F.col("fingerprint")))
    severity = F.upper(blank_free(F.col("severity")))
    state = F.concat_ws("|", blank_free(F.col("rule_id")), blank_free(F.col("file")), severity)
    rows = findings.select("snapshot_no", key.alias("finding_key"), F.struct(utc_time(F.col("last_seen")).alias("seen"), state.alias("state"), F.coalesce("active", F.lit(0)).alias("active"), severity.alias("severity")).alias("v"))
    last = rows.where("finding_key is not null and snapshot_no is not null").groupBy("snapshot_no", "finding_key").agg(F.max("v").alias("v"))
    # one row for each snapshot, so the window without a partition holds a handful
    numbers = findings.where("snapshot_no is not null").select("snapshot_no").distinct().withColumn("at", F.row_number().over(Window.orderBy("snapshot_no")) - 1)
    return last.join(F.broadcast(numbers), "snapshot_no").select("finding_key", "snapshot_no", "at", "v.state", "v.severity", "v.active")


def consecutive(states: DataFrame) -> DataFrame:
    """snapshot_no, finding_key, a, b: each identity in a snapshot (b) and in the one delivered before it (a), null where it isn't there.

    Every row takes both parts, once for its own snapshot and once for the next: one grouping compares all snapshots.
    """
    numbers = states.select("at", "snapshot_no").distinct()
    value = F.struct("state", "severity", "active")
    parts = states.select("finding_key", F.explode(F.array(F.struct(F.col("at").alias("at"), value.alias("b"), F.lit(None).cast("struct<state: string, severity: string, active: int>").alias("a")), F.struct((F.col("at") + 1).alias("at"), F.lit(None).cast("struct<state: string, severity: string, active: int>").alias("b"), value.alias("a")))).alias("p"))
    pairs = parts.where("p.at > 0").groupBy("p.at", "finding_key").agg(F.max("p.a").alias("a"), F.max("p.b").alias("b"))
    return pairs.join(F.broadcast(numbers), "at").select("snapshot_no", "finding_key", "a", "b")


def snapshot_diff(findings: DataFrame) -> DataFrame:
    """snapshot_no, finding_key, change of each snapshot against the one before: added, removed, changed or same in rule, file and severity."""
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a.state") == F.col("b.state"), "same").otherwise("changed")
    return consecutive(finding_states(findings)).select("snapshot_no", "finding_key", change.alias("change"))


def lifecycle(findings: DataFrame) -> DataFrame:
    """snapshot_no, finding_key, status: NEW when first seen, EXISTING if active in the snapshot before, REOPENED if seen earlier and not active since, RESOLVED when gone or inactive.

    History is never forgotten: a window over all snapshots of an identity tells what comes back from what is new.
    """
    states = finding_states(findings).select("finding_key", "at", "active")
    numbers = F.broadcast(finding_states(findings).select("at", "snapshot_no").distinct())
    by_key = Window.partitionBy("finding_key").orderBy("at")
    s = states.withColumn("before", F.lag(F.struct("at", "active")).over(by_key)).withColumn("after", F.lead(F.struct("at", "active")).over(by_key))
    went_on = (F.col("before.at") == F.col("at") - 1) & (F.col("before.active") == 1)
    now = F.when(F.col("active") == 1, F.when(F.col("before").isNull(), "NEW").when(went_on, "EXISTING").otherwise("REOPENED"))
    stays = F.coalesce((F.col("after.at") == F.col("at") + 1) & (F.col("after.active") == 1), F.lit(False))
    ends = F.when((F.col("active") == 1) & ~stays, "RESOLVED")
    both = s.select("finding_key", F.explode(F.array(F.struct("at", now.alias("status")), F.struct((F.col("at") + 1).alias("at"), ends.alias("status")))).alias("e"))
    return both.where("e.status is not null").select("finding_key", "e.at", "e.status").join(numbers, "at").select("snapshot_no", "finding_key", "status")


def baseline_status(scan: DataFrame, baseline: DataFrame) -> DataFrame:
    """finding_no, finding_key, status: EXISTING where either fingerprint of a finding is in the baseline, else NEW; RESOLVED (finding_no null) for each identity of the baseline of which neither is in the scan.

    Semi and anti joins, one for each key, in place of one join on "this or that", which could only be a nested loop.
    """
    norm = lambda c: F.lower(present(F.col(c)))
    both = lambda df: df.select(norm("fingerprint").alias("f"), norm("semantic_fingerprint").alias("s"))
    rows = normal_findings(scan, "fingerprint", "semantic_fingerprint")
    mine, base = rows.select("finding_no", norm("fingerprint").alias("f"), norm("semantic_fingerprint").alias("s")), both(baseline).distinct()
    key = F.coalesce("s", "f").alias("finding_key")
    old = [mine.join(base.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_semi").select("finding_no") for k in "fs"]
    known = old[0].unionByName(old[1]).distinct().withColumn("old", F.lit(True))
    present_now = mine.join(known, "finding_no", "left").select("finding_no", key, F.when(F.col("old"), "EXISTING").otherwise("NEW").alias("status"))
    gone = base.where("f is not null or s is not null")
    for k in "fs":
        gone = gone.join(mine.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return present_now.unionByName(gone.select(F.lit(None).cast("bigint").alias("finding_no"), key, F.lit("RESOLVED").alias("status")).distinct())


def fix_check(findings: DataFrame) -> DataFrame:
    """snapshot_no, status, n_removed, n_persisted, n_new_severe: whether each snapshot fixes the active findings of the one before.

    NOT_FIXED while one of them is left, else REGRESSION_DETECTED where a new one is HIGH or CRITICAL, else
    VERIFIED_BY_RESCAN where one is gone, else NO_MATCHING_FINDING.
    """
    pairs = consecutive(finding_states(findings).where("active = 1"))
    n = lambda c: F.count_if(c)
    was, now = F.col("a").isNotNull(), F.col("b").isNotNull()
    counted = pairs.groupBy("snapshot_no").agg(n(was & ~now).alias("n_removed"), n(was & now).alias("n_persisted"), n(~was & now & F.col("b.severity").isin("HIGH", "CRITICAL")).alias("n_new_severe"))
    status = F.when(F.col("n_persisted") > 0, "NOT_FIXED").when(F.col("n_new_severe") > 0, "REGRESSION_DETECTED").when(F.col("n_removed") > 0, "VERIFIED_BY_RESCAN").otherwise("NO_MATCHING_FINDING")
    return counted.select("snapshot_no", status.alias("status"), "n_removed", "n_persisted", "n_new_severe")


def feedback_match(scan: DataFrame, feedback: DataFrame) -> DataFrame:
    """finding_no, weight, verdict: the best earlier verdict on a finding.

    ``feedback`` has entry_no (in order), semantic_fingerprint, rule_id, sink_kind, verdict and, if known, ast_fingerprint. An
    entry on the finding's own identity (its fingerprint where it has no semantic one) weighs 1.0; else of entries on its rule, and
    on its sink or on none, the first with the same syntax tree 0.95, else the last 0.7. Of several entries on an
    identity the last counts. Findings without a match are left out.
    """
    trees = "ast_fingerprint" in scan.columns and "ast_fingerprint" in feedback.columns
    norm = lambda c: F.lower(present(F.col(c)))
    rows = normal_findings(scan, "semantic_fingerprint", "fingerprint", "rule_id", "sink_kind", *(["ast_fingerprint"] if trees else [])).select(
        "finding_no", F.coalesce(norm("semantic_fingerprint"), norm("fingerprint")).alias("s"), "rule_id", blank_free(F.col("sink_kind")).alias("sink"), *([present(F.col("ast_fingerprint")).alias("tree")] if trees else [])
    )
    said = feedback.select("entry_no", norm("semantic_fingerprint").alias("s"), present(F.col("rule_id")).alias("rule_id"), blank_free(F.col("sink_kind")).alias("sink"), "verdict", *([present(F.col("ast_fingerprint")).alias("tree")] if trees else []))
    entry = F.struct("entry_no", "verdict")
    out = rows.join(said.where("s is not null").groupBy("s").agg(F.max(entry).alias("own")), "s", "left")
    ruled = said.where("rule_id is not null")
    anywhere = ruled.where("sink = ''").groupBy("rule_id").agg(F.max(entry).alias("last_any"))
    there = ruled.where("sink <> ''").groupBy("rule_id", "sink").agg(F.max(entry).alias("last_there"))
    out = out.join(anywhere, "rule_id", "left").join(there, ["rule_id", "sink"], "left")
    tree = F.lit(None).cast("string")
    if trees:
        grown = ruled.where("tree is not null")
        out = out.join(grown.where("sink = ''").groupBy("rule_id", "tree").agg(F.min(entry).alias("tree_any")), ["rule_id", "tree"], "left")
        out = out.join(grown.where("sink <> ''").groupBy("rule_id", "sink", "tree").agg(F.min(entry).alias("tree_there")), ["rule_id", "sink", "tree"], "left")
        tree = F.least("tree_any", "tree_there")["verdict"]
    last = F.greatest("last_any", "last_there")["verdict"]
    weight = F.when(F.col("own").isNotNull(), 1.0).when(tree.isNotNull(), 0.95).when(last.isNotNull(), 0.7)
    return out.select("finding_no", weight.alias("weight"), F.coalesce(F.col("own.verdict"), tree, last).alias("verdict")).where("weight is not null")


def changed_dependents(dependencies: DataFrame) -> DataFrame:
    """file: those whose rows, over all times, name different files to depend on."""
    rows = dependencies.select(plain_path(F.col("file")).alias("file"), F.coalesce(plain_path(F.col("depends_on")), F.lit("")).alias("on")).where("file is not null")
    return rows.groupBy("file").agg(F.min("on").alias("lo"), F.max("on").alias("hi")).where("lo <> hi").select("file")


def reached_files(dependencies: DataFrame, changed: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """file, distance: the ``changed`` files (file) among all, and those that depend on them over any recorded row.

    Unlike the hierarchy, every row counts as a link. Files with one link only are chains: pointer doubling takes each to the
    next changed, forking or last file. Distances then travel over forks alone, round by round until none gets
    shorter, so circles do no harm and depth costs rounds only where it forks.
    """
    scratch = scratch or Scratch(dependencies.sparkSession, "reach")
    links = dependencies.select(plain_path(F.col("file")).alias("id"), plain_path(F.col("depends_on")).alias("nxt")).where("id is not null and nxt is not null and id <> nxt").distinct()
    links = scratch.keep(links, "links")
    files = links.select("id").unionByName(links.select(F.col("nxt").alias("id"))).distinct()
    seeds = scratch.keep(files.join(changed.select(F.col("file").alias("id")), "id", "left_semi").distinct(), "seeds")
    rest = links.join(seeds, "id", "left_anti")
    single = rest.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id")
    chains = scratch.keep(single, "single")
    goes_on = chains.select(F.col("id").alias("nxt"), F.lit(False).alias("stop"))
    step = rest.join(goes_on, "nxt", "left").select("id", "nxt", F.coalesce("stop", F.lit(True)).alias("stop"), F.lit(1).alias("steps"))
    walked, _, _ = _jump(scratch, scratch.keep(step.join(chains, "id", "left_semi"), "walk-0"), [], ["steps"], "walk")
    walked = scratch.keep(walked.select("id", "nxt", "steps"), "walked")
    forks = step.join(chains, "id", "left_anti")
    onward = walked.select(F.col("id").alias("nxt"), F.col("nxt").alias("place"), F.col("steps").alias("more"))
    edges = forks.join(onward, "nxt", "left").where("stop or place is not null").select("id", F.coalesce("place", "nxt").alias("nxt"), (F.lit(1) + F.coalesce("more", F.lit(0))).alias("steps"))
    edges = scratch.keep(edges.groupBy("id", "nxt").agg(F.min("steps").alias("steps")), "edges")
    reached = seeds.withColumn("distance", F.lit(0))
    fresh = reached
    while True:
        near = edges.join(fresh.select(F.col("id").alias("nxt"), "distance"), "nxt").groupBy("id").agg(F.min(F.col("distance") + F.col("steps")).alias("distance"))
        fresh = scratch.keep(near.join(reached.withColumnRenamed("distance", "best"), "id", "left").where("best is null or distance < best").select("id", "distance"), "fresh")
        if fresh.isEmpty():
            break
        reached = scratch.keep(reached.unionByName(fresh).groupBy("id").agg(F.min("distance").alias("distance")), "reached")
    along = walked.join(reached.withColumnRenamed("id", "nxt"), "nxt").select("id", (F.col("steps") + F.col("distance")).alias("distance"))
    return reached.unionByName(along).select(F.col("id").alias("file"), "distance")


def reusable(scan: DataFrame, source_files: DataFrame) -> DataFrame:
    """finding_no of findings none of whose files (their own and their related locations') was indexed after they were detected.

    A file without a readable time, or one that isn't indexed at all, makes nothing stale; a finding of unknown time stays
    reusable while no file of it is indexed.
    """
    rows = normal_findings(scan, "file", "secret_related_locations", "detected_at")
    places = F.transform(F.coalesce("secret_related_locations", F.array().cast("array<string>")), lambda x: plain_path(F.regexp_replace(x, r":\d+$", "")))
    touched = rows.select("finding_no", "detected_at", F.explode(F.array_union(F.array("file"), places)).alias("file"))
    indexed = source_files.select(plain_path(F.col("path")).alias("file"), F.col("indexed_at").cast("timestamp_ntz").alias("t")).where("file is not null and t is not null").groupBy("file").agg(F.max("t").alias("t"))
    since = F.col("detected_at").cast("timestamp_ntz")
    stale = touched.join(indexed, "file").where(since.isNull() | (F.col("t") > since)).select("finding_no").distinct()
    return rows.select("finding_no").distinct().join(stale, "finding_no", "left_anti")

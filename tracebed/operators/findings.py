"""Findings: normal form, identities, gates, suppression, order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracebed.functions.text import blank_free, plain_path
from tracebed.session import Scratch

# fixed values: severities from worst to least, confidences likewise
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")


def severity_rank(col: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.upper(blank_free(col))).cast("int")
    return F.when(place > 0, place - 1).otherwise(len(SEVERITIES))


def confidence_rank(col: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, CONFIDENCES)), F.upper(blank_free(col))).cast("int")
    return F.when(place > 0, place - 1).otherwise(len(CONFIDENCES))


def normal_findings(scan: DataFrame, *columns: str) -> DataFrame:
    """Each finding once (whole rows repeated count once), severity in capitals, file in one spelling.

    Only ``columns`` are read; finding_no always is.
    """
    wanted = list(dict.fromkeys(("finding_no", *columns)))
    rows = scan.select(*wanted).distinct()
    if "severity" in wanted:
        rows = rows.withColumn("severity", F.upper(F.trim("severity")))
    if "file" in wanted:
        rows = rows.withColumn("file", plain_path(F.col("file")))
    return rows


def joined_cwe(cwe: Column) -> Column:
    """The sorted weakness numbers joined by commas, '' for none."""
    return F.coalesce(F.array_join(F.array_sort(F.filter(cwe, lambda c: c.isNotNull())), ","), F.lit(""))


def problem_type(own: Column, cwe: Column, rule: Column) -> Column:
    """A finding's type: its own, else its weaknesses, else the last part of its rule's name in small letters."""
    return F.coalesce(F.nullif(F.trim(own), F.lit("")), F.nullif(joined_cwe(cwe), F.lit("")), F.lower(F.element_at(F.split(F.coalesce(rule, F.lit("")), r"\."), -1)))


def position_parts() -> Column:
    """What a finding's position identity is made of, over its columns."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws("|", text("file"), text("start_line"), text("end_line"), joined_cwe(F.col("cwe")), problem_type(F.col("normalized_type"), F.col("cwe"), F.col("rule_id")))


def position_fingerprint(scan: DataFrame) -> DataFrame:
    """finding_no, fp: SHA-256 of file, span, weaknesses and type."""
    rows = normal_findings(scan, "file", "start_line", "end_line", "cwe", "normalized_type", "rule_id")
    return rows.select("finding_no", F.sha2(position_parts(), 256).alias("fp"))


def code_identity(snippet: Column, most: int = 24) -> Column:
    """A snippet without line numbers, with single blanks, without empty lines, its first ``most`` lines."""
    lines = F.transform(F.split(F.coalesce(snippet, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^ *[0-9]+: ?", ""), r"[ \t]+", " ")))
    return F.array_join(F.slice(F.filter(lines, lambda x: x != ""), 1, most), "\n")


def semantic_parts() -> Column:
    """What a finding's semantic identity is made of, over its columns; the span joins it only where nothing else tells."""
    code = code_identity(F.col("code_snippet"))
    said = F.concat(blank_free(F.col("source_kind")), blank_free(F.col("sink_kind")), code)
    span = F.when(said == "", F.concat_ws("|", F.lit(""), F.col("start_line").cast("string"), F.col("end_line").cast("string"))).otherwise("")
    parts = F.concat_ws("|", F.lit("v2"), F.coalesce("file", F.lit("")), problem_type(F.col("normalized_type"), F.col("cwe"), F.col("rule_id")), joined_cwe(F.col("cwe")), blank_free(F.col("source_kind")), blank_free(F.col("sink_kind")), code)
    return F.concat(parts, span)


def semantic_identity(scan: DataFrame) -> DataFrame:
    """finding_no, fp: an identity that survives moved lines."""
    rows = normal_findings(scan, "file", "start_line", "end_line", "cwe", "normalized_type", "rule_id", "source_kind", "sink_kind", "code_snippet")
    return rows.select("finding_no", F.sha2(semantic_parts(), 256).alias("fp"))


def corroborated(detected_by: Column, tool: Column, correlation: Column) -> Column:
    """Two engines at least (the tool itself where none is named), or a correlation of 0.85."""
    engines = F.coalesce(F.when(F.size(detected_by) > 0, F.size(F.array_distinct(detected_by))), F.lit(1))
    return (engines >= 2) | (F.coalesce(correlation, F.lit(0.0)) >= 0.85)


def precision_gate(scan: DataFrame, profile: str = "smart", native: str = "*-engine") -> DataFrame:
    """finding_no, kept: whether a finding passes the profile strict, smart, audit or experimental.

    smart leaves out what nothing corroborates if it is experimental, or of low confidence and found by the ``native``
    tool (a glob); audit leaves out uncorroborated experimental findings alone; strict keeps very precise ones, and precise
    ones of high confidence that are corroborated; experimental keeps all.
    """
    rows = normal_findings(scan, "tool", "precision_level", "confidence", "detected_by", "correlation_score")
    level, sure = F.upper(blank_free(F.col("precision_level"))), F.upper(blank_free(F.col("confidence")))
    more = corroborated(F.col("detected_by"), F.col("tool"), F.col("correlation_score"))
    experimental = (level == "EXPERIMENTAL") & ~more
    kept = {
        "strict": (level == "VERY_HIGH") | (more & (sure == "HIGH") & (level == "HIGH")),
        "smart": ~experimental & ~(blank_free(F.col("tool")).rlike(glob_regex(native)) & (sure == "LOW") & ~more),
        "audit": ~experimental,
        "experimental": F.lit(True),
    }[profile]
    return rows.select("finding_no", kept.alias("kept"))


def glob_regex(glob: str) -> str:
    """A shell pattern as an anchored regex of the dialect that Java and RE2 share; ``*`` crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "(?s:.*)"
        elif c == "?":
            out += "(?s:.)"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += "\\" + c if c in r"\.^$|+(){}[]" else c
        i += 1
    return f"^{out}$"


def suppressed_by(scan: DataFrame, entries: list[dict], today: str, fingerprints: tuple[str, ...] = (), rules: tuple[str, ...] = ()) -> DataFrame:
    """finding_no, reason of each finding that is suppressed: by a fingerprint, else by a rule, else by the first entry that matches.

    An entry has reason (by default 'scoped suppression'), approved_by, and any of rule, fingerprint, path (a glob) and
    expires (a day that still counts); one with neither rule nor fingerprint never matches. Fingerprints compare with
    either of a finding's, without their prefix. Entries are few and written into the plan, so no join is needed.
    """
    rows = normal_findings(scan, "rule_id", "fingerprint", "semantic_fingerprint", "file")
    bare = lambda c: F.regexp_replace(blank_free(F.col(c)), "^sha256:", "")
    is_one_of = lambda fps: bare("fingerprint").isin(*fps) | bare("semantic_fingerprint").isin(*fps)
    tests = [F.when(is_one_of([f.removeprefix("sha256:") for f in fingerprints]), "fingerprint")] if fingerprints else []
    tests += [F.when(F.col("rule_id").isin(*rules), "rule")] if rules else []
    for e in entries:
        fp = (e.get("fingerprint") or "").removeprefix("sha256:")
        if (e.get("expires") and e["expires"] < today) or not (e.get("rule") or fp):
            continue
        hit = F.coalesce("file", F.lit("")).rlike(glob_regex(e.get("path") or "**"))
        if e.get("rule"):
            hit = hit & (F.col("rule_id") == e["rule"])
        if fp:
            hit = hit & is_one_of([fp])
        said = e.get("reason") or "scoped suppression"
        tests.append(F.when(hit, said + (f" (approved by {e['approved_by']})" if e.get("approved_by") else "")))
    reason = F.coalesce(*tests) if tests else F.lit(None).cast("string")
    return rows.select("finding_no", reason.alias("reason")).where("reason is not null")


@dataclass(frozen=True)
class Policy:
    """What a project doesn't allow: findings of some categories under a path (a glob), from a severity on."""

    name: str
    severity: str
    categories: tuple[str, ...]
    path: str = "**"


def policy_violations(scan: DataFrame, policies: list[Policy]) -> DataFrame:
    """policy, finding_no, rule_id, file, severity of each finding that a policy denies and nothing suppresses.

    Policies are few and written into the plan: one pass, no theta join. A severity that isn't known denies nothing.
    """
    rows = normal_findings(scan, "rule_id", "category", "severity", "file", "suppressed").where("suppressed is null or not suppressed")
    rank = severity_rank(F.col("severity"))
    hits = F.array(*(
        F.when(F.col("category").isin(*p.categories) & (rank <= SEVERITIES.index(p.severity)) & F.coalesce("file", F.lit("")).rlike(glob_regex(p.path)), p.name) for p in policies
    ))
    return rows.select(F.explode(F.array_compact(hits)).alias("policy"), "finding_no", "rule_id", "file", "severity")


def failing(scan: DataFrame, level: str) -> DataFrame:
    """finding_no, severity of the findings that aren't suppressed and at least as severe as ``level``; any row fails the scan."""
    if level.upper() not in SEVERITIES:
        raise ValueError(f"no severity: {level}")
    rows = normal_findings(scan, "severity", "suppressed").where("suppressed is null or not suppressed")
    return rows.where(severity_rank(F.col("severity")) <= SEVERITIES.index(level.upper())).select("finding_no", "severity")


def positions(scan: DataFrame) -> DataFrame:
    """finding_no, position from 1 in order of severity, confidence, file, line and number.

    The order is global, so it is built from ranges: rows are range-partitioned by the sort key, sorted within each range, and
    numbered by the counts of the ranges before theirs, one row each.
    """
    scratch = Scratch(scan.sparkSession, "numbered")
    rows = normal_findings(scan, "severity", "confidence", "file", "start_line")
    keyed = rows.select("finding_no", severity_rank(F.col("severity")).alias("sr"), confidence_rank(F.col("confidence")).alias("cr"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("start_line", F.lit(0)).alias("line"))
    order = ("sr", "cr", "file", "line", "finding_no")
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number inside a range is the low half of the id that Spark gives the rows of a partition in order
    placed = scratch.keep(ranged.withColumn("id", F.monotonically_increasing_id()).select("finding_no", F.shiftright("id", 33).alias("range"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ranges")
    counts = placed.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "range").select("finding_no", (F.col("before") + F.col("at") + 1).alias("position"))


def numbered(scan: DataFrame, prefix: str = "F", year: int = 2026) -> DataFrame:
    """finding_no, report_id: ids in the order of ``positions``."""
    return positions(scan).select("finding_no", F.format_string(f"{prefix}-{year}-%06d", "position").alias("report_id"))


def merged_findings(scan: DataFrame) -> DataFrame:
    """One row for each position fingerprint: the worst severity's first row, with engines united in order of their names.

    The longest message and the greatest scores win. Engines are told apart before they are gathered, so that a list is as
    long as there are engines, however many rows a position has.
    """
    rows = normal_findings(scan, "file", "start_line", "end_line", "cwe", "normalized_type", "rule_id", "severity", "detected_by", "message", "confidence_score")
    rows = rows.withColumn("kind", problem_type(F.col("normalized_type"), F.col("cwe"), F.col("rule_id"))).withColumn("sr", severity_rank(F.col("severity")))
    # a null line is a value of its own here
    key = ["file", "start", "end", "kind"]
    rows = rows.withColumn("file", F.coalesce("file", F.lit(""))).withColumn("start", F.coalesce("start_line", F.lit(-1))).withColumn("end", F.coalesce("end_line", F.lit(-1)))
    engines = rows.select(*key, F.explode_outer("detected_by").alias("engine")).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"))
    merged = rows.groupBy(*key).agg(
        F.min(F.struct("sr", "finding_no")).alias("best"),
        F.count("*").alias("n"),
        F.max(F.length(F.coalesce("message", F.lit("")))).alias("message_chars"),
        F.max("confidence_score").alias("confidence_score"),
    )
    line = lambda c: F.nullif(F.col(c), F.lit(-1))
    return merged.join(engines, key).select("file", line("start").alias("start_line"), line("end").alias("end_line"), "kind", F.col("best.finding_no").alias("finding_no"), F.col("best.sr").alias("severity_rank"), "n", "engines", "message_chars", "confidence_score")

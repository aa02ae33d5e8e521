"""Aggregates over findings: counts, scores, distributions, hotspots, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracebed.functions.text import blank_free
from tracebed.operators.findings import SEVERITIES, normal_findings, severity_rank

# fixed values: weight of a finding by severity, and its factor by confidence
WEIGHTS = {"CRITICAL": 10.0, "HIGH": 7.0, "MEDIUM": 4.0, "LOW": 1.0, "INFO": 0.0}
CONFIDENCE_FACTORS = {"HIGH": 1.0, "MEDIUM": 0.85, "LOW": 0.65}
# fixed values: minutes of debt by category and severity
DEBT_MINUTES = {
    "duplicate": {"HIGH": 60, "MEDIUM": 30, "LOW": 15},
    "code_smell": {"HIGH": 45, "MEDIUM": 20, "LOW": 8},
    "complexity": {"HIGH": 45, "MEDIUM": 20, "LOW": 8},
    "bug": {"HIGH": 45, "MEDIUM": 20, "LOW": 8},
    "quality": {"HIGH": 30, "MEDIUM": 15, "LOW": 5},
}


def lookup(col: Column, table: dict, otherwise=0.0) -> Column:
    """A small fixed table as an expression."""
    out = F.lit(otherwise)
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)).otherwise(out)
    return out


def active(scan: DataFrame, *columns: str) -> DataFrame:
    """Findings that aren't suppressed, each once."""
    return normal_findings(scan, *columns, "suppressed").where("suppressed is null or not suppressed")


def severity_counts(scan: DataFrame) -> DataFrame:
    """severity, n for every severity, 0 where there is none."""
    counted = active(scan, "severity").groupBy("severity").agg(F.count("*").alias("n"))
    every = scan.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return every.join(counted, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def risk_by_project(scan: DataFrame) -> DataFrame:
    """project, n, raw, risk, band of security and secret findings: 100 (1 - exp(-raw / 40)) as a whole number, each finding's weight times its factor."""
    rows = active(scan, "project", "severity", "category", "confidence", "confidence_score", "reachable", "exploitability_score", "detected_by").where("category in ('security', 'secret')")
    known = F.when(F.col("confidence_score").isNotNull(), F.col("confidence_score")).otherwise(lookup(F.upper(blank_free(F.col("confidence"))), CONFIDENCE_FACTORS, 0.85))
    reach = F.when(~F.col("reachable"), 0.35).otherwise(1.0)
    exploit = F.when(F.col("exploitability_score").isNotNull(), 0.5 + F.col("exploitability_score") / 200).otherwise(1.0)
    engines = F.size(F.array_distinct(F.coalesce("detected_by", F.array().cast("array<string>"))))
    consensus = 1 + F.least(F.lit(0.25), 0.08 * F.greatest(engines - 1, F.lit(0)))
    factor = F.least(F.lit(1.5), F.greatest(F.lit(0.1), known * reach * exploit * consensus))
    # decimals add up to the same sum in any order
    raw = F.round(F.sum((lookup(F.col("severity"), WEIGHTS) * factor).cast("decimal(20, 12)")), 6).cast("double")
    out = rows.groupBy("project").agg(F.count("*").alias("n"), raw.alias("raw"))
    # halves go to the even number, as the score's definition has it
    risk = F.bround(100 * (1 - F.exp(-F.col("raw") / 40))).cast("int")
    out = out.withColumn("risk", risk)
    band = F.when(F.col("risk") <= 19, "LOW").when(F.col("risk") <= 39, "MODERATE").when(F.col("risk") <= 69, "HIGH").otherwise("CRITICAL")
    return out.withColumn("band", band)


def maintainability(scan: DataFrame, lines: DataFrame) -> DataFrame:
    """project, debt_minutes, n_lines, ratio, rating: minutes of debt against a tenth of the lines."""
    cost = F.lit(0)
    for category, table in DEBT_MINUTES.items():
        for severity, minutes in table.items():
            cost = F.when((F.col("category") == category) & (F.col("severity") == severity), minutes).otherwise(cost)
    debt = active(scan, "project", "category", "severity").groupBy("project").agg(F.sum(cost).alias("debt_minutes"))
    size = lines.select("project", "file_no", "line_no").distinct().groupBy("project").agg(F.count("*").alias("n_lines"))
    out = debt.join(size, "project", "left").fillna(0, ["n_lines"])
    out = out.withColumn("ratio", F.round(F.col("debt_minutes") / F.greatest(F.col("n_lines") / 10, F.lit(1.0)), 6))
    rating = F.when(F.col("ratio") < 0.05, "A").when(F.col("ratio") < 0.1, "B").when(F.col("ratio") < 0.2, "C").when(F.col("ratio") < 0.3, "D").otherwise("E")
    return out.withColumn("rating", rating)


def smell_breakdown(scan: DataFrame) -> DataFrame:
    """category, rule_id, n of findings that aren't about security."""
    rows = active(scan, "category", "rule_id").where("category not in ('security', 'secret')")
    return rows.groupBy("category", "rule_id").agg(F.count("*").alias("n"))


def weakness_distribution(scan: DataFrame, most: int = 15) -> DataFrame:
    """cwe, n, pct of all weakness mentions; the ``most`` frequent, ties by name. A report of top entries by nature."""
    said = active(scan, "cwe").select(F.explode("cwe").alias("cwe")).where("trim(cwe) <> ''").groupBy("cwe").agg(F.count("*").alias("n"))
    whole = said.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))
    return whole.orderBy(F.desc("n"), "cwe").limit(most)


def hotspots(scan: DataFrame, most: int = 10) -> DataFrame:
    """kind (folder or file), place, weight, n, worst: the heaviest places of either kind, ties by name; files at the root are in '(root)/'."""
    rows = active(scan, "file", "severity").where("file is not null")
    weighed = rows.select(
        F.explode(F.array(F.struct(F.lit("file").alias("kind"), F.col("file").alias("place")), F.struct(F.lit("folder").alias("kind"), F.when(F.contains("file", F.lit("/")), F.concat(F.substring_index("file", "/", 1), F.lit("/"))).otherwise("(root)/").alias("place")))).alias("p"),
        lookup(F.col("severity"), WEIGHTS).alias("w"),
        severity_rank(F.col("severity")).alias("sr"),
    )
    places = weighed.groupBy("p.kind", "p.place").agg(F.sum("w").alias("weight"), F.count("*").alias("n"), F.min("sr").alias("worst"))
    order = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("weight"), "place"))
    return places.withColumn("r", order).where(F.col("r") <= most).drop("r")


def endpoint_rollup(scan: DataFrame) -> DataFrame:
    """http_method, endpoint, n, exposed, open, max_score: exposed if any finding is, open if any needs no login; unknown stays null."""
    rows = active(scan, "endpoint", "http_method", "internet_exposed", "authentication_required", "exploitability_score").where("trim(endpoint) <> ''")
    return rows.groupBy(F.upper(blank_free(F.col("http_method"))).alias("http_method"), F.trim("endpoint").alias("endpoint")).agg(
        F.count("*").alias("n"), F.max("internet_exposed").alias("exposed"), F.max(~F.col("authentication_required")).alias("open"), F.max("exploitability_score").alias("max_score")
    )


def tool_quality(scan: DataFrame) -> DataFrame:
    """engine, n, shared: findings each engine contributed to, and those that another engine saw too."""
    rows = active(scan, "detected_by").select(F.array_distinct("detected_by").alias("by"))
    return rows.select(F.explode("by").alias("engine"), F.size("by").alias("engines")).groupBy("engine").agg(F.count("*").alias("n"), F.sum((F.col("engines") > 1).cast("long")).alias("shared"))


def lifecycle_counts(scan: DataFrame) -> DataFrame:
    """batch_no, status, n."""
    rows = normal_findings(scan, "batch_no", "lifecycle_status")
    return rows.groupBy("batch_no", F.coalesce(F.nullif(F.upper(F.trim("lifecycle_status")), F.lit("")), F.lit("UNSET")).alias("status")).agg(F.count("*").alias("n"))


def detection_quality(scan: DataFrame, truth: Column, positive: Column, columns: list[str]) -> DataFrame:
    """project, tp, fp, fn, precision, recall, f1 of a predicate against another; an empty denominator counts as 1, f1 of nothing as 0."""
    rows = normal_findings(scan, "project", *columns)
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(positive, F.lit(False))
    n = lambda c: F.sum(c.cast("long"))
    out = rows.groupBy("project").agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"))
    ratio = lambda a, b: F.when(b == 0, 1.0).otherwise(F.round(a / b, 6))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = F.when(2 * tp + fp + fn == 0, 0.0).otherwise(F.round(2 * tp / (2 * tp + fp + fn), 6))
    return out.select("project", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1.alias("f1"))


def folder_rollup(scan: DataFrame) -> DataFrame:
    """project, severity, n, level: counts of each pair, each project and all, by one rollup."""
    rows = active(scan, "project", "severity")
    return rows.rollup("project", "severity").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))

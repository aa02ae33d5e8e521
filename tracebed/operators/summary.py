"""What a report says of findings: security classes, status, titles, when to mend them, quick wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracebed.functions.text import blank_free
from tracebed.operators.findings import confidence_rank, normal_findings, severity_rank
from tracebed.operators.metrics import active

# fixed values: security class by weakness number, and by category where the category decides
WEAKNESS_CLASSES = {
    "Injection": ("78", "89", "77", "90", "94", "95", "79", "80"),
    "Path Traversal": ("22", "23", "36", "73"),
    "Secrets": ("798", "259", "321", "256"),
    "Authentication": ("287", "306", "307", "384"),
    "Authorization": ("862", "863", "284", "285"),
    "Cryptography": ("327", "328", "326", "330", "338"),
    "Deserialization": ("502",),
    "Data Exposure": ("200", "209", "312", "359"),
    "Input Validation": ("20", "116"),
    "Resource Management": ("400", "770"),
    "Configuration": ("918", "611", "776"),
}
CATEGORY_CLASSES = {"secret": "Secrets", "complexity": "Resource Management", "quality": "Configuration", "bug": "Business Logic", "maintainability": "Configuration"}
# fixed values: rules and weaknesses that mean a credential in code, and what to do about them
CREDENTIAL_RULES, CREDENTIAL_WEAKNESSES = ("B105", "B106", "B107"), ("798", "259")
ROTATE = "Remove committed credential and rotate the exposed secret."
USE_STORE = "Remove hard-coded credential and load secrets from a secure secret store."
TITLE = 100


def weakness_numbers(cwe: Column) -> Column:
    """The numbers of weaknesses written as CWE-n or n, in their order."""
    numbers = F.transform(F.coalesce(cwe, F.array().cast("array<string>")), lambda c: F.regexp_extract(F.upper(F.trim(c)), r"^(?:CWE-)?(\d+)$", 1))
    return F.filter(numbers, lambda n: n != "")


def security_class(category: Column, cwe: Column) -> Column:
    """The class that the category decides, else that of the first weakness which has one, else Input Validation for security findings, Configuration for others."""
    table = F.create_map(*(F.lit(x) for name, numbers in WEAKNESS_CLASSES.items() for n in numbers for x in (n, name)))
    known = F.filter(F.transform(weakness_numbers(cwe), lambda n: F.try_element_at(table, n)), lambda c: c.isNotNull())
    decided = F.try_element_at(F.create_map(*(F.lit(x) for pair in CATEGORY_CLASSES.items() for x in pair)), category)
    return F.coalesce(decided, F.get(known, 0), F.when(category == "security", "Input Validation").otherwise("Configuration"))


def class_distribution(scan: DataFrame) -> DataFrame:
    """name, n, pct (one decimal) of the security classes of findings that aren't suppressed."""
    counted = active(scan, "category", "cwe").groupBy(security_class(F.col("category"), F.col("cwe")).alias("name")).agg(F.count("*").alias("n"))
    # one row for each class: the window holds a dozen
    return counted.select("name", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1).alias("pct"))


def title(message: Column, rule: Column) -> Column:
    """The message, else the rule, else 'Finding': without outer blanks, long runs of masks shortened, clipped at TITLE characters."""
    text = F.coalesce(F.nullif(message, F.lit("")), F.nullif(rule, F.lit("")), F.lit("Finding"))
    text = F.trim(text)
    for pattern, short in ((r"\*{6,}", "*" * 12), ("•{6,}", "•" * 4), ("(?i)X{8,}", "X" * 8)):
        text = F.regexp_replace(text, pattern, short)
    return F.when(F.length(text) <= TITLE, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, TITLE - 3)), F.lit("...")))


def display(scan: DataFrame) -> DataFrame:
    """finding_no, status, title: Suppressed, Potential Finding at low confidence, the lifecycle's word where there is one, else Needs Review.

    Findings here carry no explanation; with one they would be Open.
    """
    rows = normal_findings(scan, "suppressed", "confidence", "lifecycle_status", "message", "rule_id")
    life = F.nullif(F.upper(blank_free(F.col("lifecycle_status"))), F.lit(""))
    status = (
        F.when(F.coalesce("suppressed", F.lit(False)), "Suppressed")
        .when(F.upper(blank_free(F.col("confidence"))) == "LOW", "Potential Finding")
        .when(life.isNotNull() & (life != "NONE"), F.concat(F.substring(life, 1, 1), F.lower(F.substr(life, F.lit(2)))))
        .otherwise("Needs Review")
    )
    return rows.select("finding_no", status.alias("status"), title(F.col("message"), F.col("rule_id")).alias("title"))


def remediation(scan: DataFrame) -> DataFrame:
    """finding_no, bucket, complexity: CRITICAL and sure HIGH findings immediate, other HIGH and MEDIUM short_term, the rest planned."""
    rows = active(scan, "category", "severity", "confidence")
    severity, sure = F.col("severity"), F.upper(blank_free(F.col("confidence"))) == "HIGH"
    bucket = F.when((severity == "CRITICAL") | ((severity == "HIGH") & sure), "immediate").when(severity.isin("HIGH", "MEDIUM"), "short_term").otherwise("planned")
    complexity = F.when(F.col("category") == "secret", "Low").when(severity.isin("CRITICAL", "HIGH"), F.when(sure, "High").otherwise("Medium")).when(severity.isin("LOW", "INFO"), "Low").otherwise("Medium")
    return rows.select("finding_no", bucket.alias("bucket"), complexity.alias("complexity"))


def quick_wins(scan: DataFrame, most: int = 8) -> DataFrame:
    """finding_no, action, place, severity of the first ``most`` findings in report order that one step mends. A report of top entries by nature."""
    rows = active(scan, "category", "severity", "confidence", "file", "start_line", "rule_id", "cwe")
    held = F.col("rule_id").isin(*CREDENTIAL_RULES) | F.coalesce(F.arrays_overlap(weakness_numbers(F.col("cwe")), F.array(*map(F.lit, CREDENTIAL_WEAKNESSES))), F.lit(False))
    action = F.when(F.col("category") == "secret", ROTATE).when(held, USE_STORE)
    place = F.concat_ws(":", F.coalesce("file", F.lit("")), F.coalesce("start_line", F.lit(0)).cast("string"))
    wins = rows.select("finding_no", action.alias("action"), place.alias("place"), "severity", severity_rank(F.col("severity")).alias("sr"), confidence_rank(F.col("confidence")).alias("cr"), F.coalesce("file", F.lit("")).alias("f"), F.coalesce("start_line", F.lit(0)).alias("l"))
    return wins.where("action is not null").orderBy("sr", "cr", "f", "l", "finding_no").limit(most).select("finding_no", "action", "place", "severity")


def exposure(scan: DataFrame) -> DataFrame:
    """project and counts of findings that aren't suppressed: n, reachable, internet_exposed, open_endpoints (exposed, known to need no login, with an endpoint), highly_exploitable (80 at least), with_code, several_engines."""
    rows = active(scan, "project", "reachable", "internet_exposed", "authentication_required", "endpoint", "exploitability_score", "code_snippet", "detected_by")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy("project").agg(
        F.count("*").alias("n"),
        n(F.col("reachable")).alias("reachable"),
        n(F.col("internet_exposed")).alias("internet_exposed"),
        n(F.col("internet_exposed") & ~F.col("authentication_required") & (F.col("endpoint") != "")).alias("open_endpoints"),
        n(F.col("exploitability_score") >= 80).alias("highly_exploitable"),
        n(F.col("code_snippet") != "").alias("with_code"),
        n(F.size(F.array_distinct("detected_by")) > 1).alias("several_engines"),
    )

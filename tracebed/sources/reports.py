"""Reports of other tools read as findings, and findings written as reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: level of a severity in SARIF
SARIF_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
# fixed values: severities of two tools in canonical form
PATTERN_SEVERITIES = {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "INFO", "CRITICAL": "CRITICAL", "HIGH": "HIGH", "MEDIUM": "MEDIUM", "LOW": "LOW"}
PYTHON_SEVERITIES = {"HIGH": "HIGH", "MEDIUM": "MEDIUM", "LOW": "LOW"}
SECRET_SEVERITY = "CRITICAL"

FINDING = "tool string, rule_id string, severity string, file string, start_line int, end_line int, message string"


def _mapped(col, table: dict, otherwise: str):
    out = F.lit(otherwise)
    for key, value in table.items():
        out = F.when(F.upper(col) == key, value).otherwise(out)
    return out


def pattern_report(spark: SparkSession, path: str) -> DataFrame:
    """Results of a pattern scanner: {results: [{check_id, path, start{line}, end{line}, extra{message, severity}}]}."""
    schema = "results array<struct<check_id: string, path: string, start: struct<line: int>, end: struct<line: int>, extra: struct<message: string, severity: string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results").alias("r"))
    return rows.select(F.lit("semgrep").alias("tool"), F.col("r.check_id").alias("rule_id"), _mapped(F.col("r.extra.severity"), PATTERN_SEVERITIES, "INFO").alias("severity"), F.col("r.path").alias("file"), F.col("r.start.line").alias("start_line"), F.col("r.end.line").alias("end_line"), F.col("r.extra.message").alias("message"))


def python_report(spark: SparkSession, path: str) -> DataFrame:
    """Results of a Python scanner: {results: [{test_id, issue_severity, issue_text, filename, line_number, line_range}]}."""
    schema = "results array<struct<test_id: string, issue_severity: string, issue_text: string, filename: string, line_number: int, line_range: array<int>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results").alias("r"))
    return rows.select(F.lit("bandit").alias("tool"), F.col("r.test_id").alias("rule_id"), _mapped(F.col("r.issue_severity"), PYTHON_SEVERITIES, "LOW").alias("severity"), F.col("r.filename").alias("file"), F.col("r.line_number").alias("start_line"), F.coalesce(F.array_max("r.line_range"), F.col("r.line_number")).alias("end_line"), F.col("r.issue_text").alias("message"))


def lint_report(spark: SparkSession, path: str) -> DataFrame:
    """Results of a linter: [{code, message, filename, location{row}, end_location{row}}]."""
    schema = "code string, message string, filename string, location struct<row: int>, end_location struct<row: int>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(F.lit("ruff").alias("tool"), F.col("code").alias("rule_id"), F.lit("LOW").alias("severity"), F.col("filename").alias("file"), F.col("location.row").alias("start_line"), F.col("end_location.row").alias("end_line"), "message")


def secret_report(spark: SparkSession, path: str) -> DataFrame:
    """Results of a secret scanner: [{RuleID, Description, File, StartLine, EndLine}]; the secret itself is never read."""
    rows = spark.read.schema("RuleID string, Description string, File string, StartLine int, EndLine int").json(path, multiLine=True)
    return rows.select(F.lit("gitleaks").alias("tool"), F.col("RuleID").alias("rule_id"), F.lit(SECRET_SEVERITY).alias("severity"), F.col("File").alias("file"), F.col("StartLine").alias("start_line"), F.col("EndLine").alias("end_line"), F.col("Description").alias("message"))


def go_report(spark: SparkSession, path: str) -> DataFrame:
    """Results of a Go scanner: {Issues: [{rule_id, severity, details, file, line}]}; a line may be a range a-b."""
    rows = spark.read.schema("Issues array<struct<rule_id: string, severity: string, details: string, file: string, line: string>>").json(path, multiLine=True).select(F.explode("Issues").alias("r"))
    line = lambda i: F.element_at(F.split("r.line", "-"), i).try_cast("int")
    return rows.select(F.lit("gosec").alias("tool"), F.col("r.rule_id").alias("rule_id"), F.upper("r.severity").alias("severity"), F.col("r.file").alias("file"), line(1).alias("start_line"), line(-1).alias("end_line"), F.col("r.details").alias("message"))


def text_report(spark: SparkSession, path: str) -> DataFrame:
    """Results in lines ``file:line:column: message``; other lines are left out."""
    rows = spark.read.text(path)
    part = lambda i: F.regexp_extract("value", r"^(.+?):(\d+):(?:\d+:)? (.+)$", i)
    return rows.where(part(1) != "").select(F.lit("govet").alias("tool"), F.lit("vet").alias("rule_id"), F.lit("MEDIUM").alias("severity"), part(1).alias("file"), part(2).cast("int").alias("start_line"), part(2).cast("int").alias("end_line"), part(3).alias("message"))


# fixed values: version and schema of a SARIF log
SARIF_VERSION, SARIF_SCHEMA = "2.1.0", "https://json.schemastore.org/sarif-2.1.0.json"
#: what ``sarif_results`` reads of a log
SARIF_READ = (
    "runs array<struct<tool: struct<driver: struct<name: string, rules: array<struct<id: string>>>>, results: array<struct<ruleId: string, ruleIndex: int, level: string, message: struct<text: string>, "
    "locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, endLine: int>>>>, fingerprints: map<string, string>, properties: struct<findingNo: bigint, tool: string, severity: string>>>>>"
)


def _uri(path):
    """A path with all but letters, digits, ``-_.~`` and slashes as percent escapes."""
    out = F.url_encode(path)
    for a, b in (("%2F", "/"), ("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def sarif_logs(scan: DataFrame, name: str = "tracebed", per_log: int = 10_000) -> DataFrame:
    """log_no, log: findings that aren't suppressed as SARIF logs in JSON, in report order, ``per_log`` results each.

    A log holds the rules that its results name, in order of their names, and every result points at its rule's place there. Logs have a
    bounded size, so no task holds more than one's results at a time; write them with ``select("log").write.text(path)``. Lines are 1 at least, a null file is
    '', a missing message is the rule's name; rows without finding_no are left out, repeated rows count once.
    """
    from tracebed.operators.findings import normal_findings, positions

    kept = scan.where("finding_no is not null and (suppressed is null or not suppressed)")
    rows = normal_findings(kept, "rule_id", "severity", "tool", "file", "start_line", "end_line", "message", "fingerprint", "semantic_fingerprint").join(positions(kept), "finding_no")
    start = F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1))
    region = F.struct(start.alias("startLine"), F.greatest(start, F.coalesce("end_line", F.lit(1))).alias("endLine"))
    place = F.struct(F.struct(F.struct(_uri(F.coalesce("file", F.lit(""))).alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        "position",
        F.coalesce("rule_id", F.lit("")).alias("ruleId"),
        _mapped(F.col("severity"), SARIF_LEVELS, "note").alias("level"),
        F.struct(F.coalesce(F.nullif("message", F.lit("")), "rule_id", F.lit("")).alias("text")).alias("message"),
        F.array(place).alias("locations"),
        F.map_filter(F.create_map(F.lit("position/v1"), F.col("fingerprint"), F.lit("semantic/v2"), F.col("semantic_fingerprint")), lambda _, v: F.coalesce(v, F.lit("")) != "").alias("fingerprints"),
        F.struct(F.col("finding_no").alias("findingNo"), "tool", "severity").alias("properties"),
    )
    logs = rows.select(F.expr(f"(position - 1) div {int(per_log)}").alias("log_no"), result.alias("r")).groupBy("log_no").agg(F.array_sort(F.collect_list("r"), lambda a, b: F.when(a["position"] < b["position"], -1).when(a["position"] > b["position"], 1).otherwise(0)).alias("rs"))
    logs = logs.withColumn("ids", F.array_sort(F.array_distinct(F.transform("rs", lambda r: r["ruleId"]))))
    results = F.transform("rs", lambda r: F.struct(r["ruleId"].alias("ruleId"), (F.array_position("ids", r["ruleId"]) - 1).cast("int").alias("ruleIndex"), *(r[k].alias(k) for k in ("level", "message", "locations", "fingerprints", "properties"))))
    driver = F.struct(F.struct(F.lit(name).alias("name"), F.transform("ids", lambda i: F.struct(i.alias("id"))).alias("rules")).alias("driver"))
    log = F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"), F.array(F.struct(driver.alias("tool"), results.alias("results"))).alias("runs"))
    return logs.select("log_no", F.to_json(log).alias("log"))


def sarif_results(logs: DataFrame) -> DataFrame:
    """log_no, finding_no, rule_id, named, level, uri, start_line, end_line, message_chars, prints of the results in logs; ``named`` is the rule that the result's index points at."""
    runs = logs.select("log_no", F.explode(F.from_json("log", SARIF_READ)["runs"]).alias("run"))
    rows = runs.select("log_no", F.col("run.tool.driver.rules").alias("rules"), F.explode("run.results").alias("r"))
    at = F.col("r.locations")[0]["physicalLocation"]
    return rows.select(
        "log_no", F.col("r.properties.findingNo").alias("finding_no"), F.col("r.ruleId").alias("rule_id"), F.col("rules")[F.col("r.ruleIndex")]["id"].alias("named"), F.col("r.level").alias("level"),
        at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("start_line"), at["region"]["endLine"].alias("end_line"), F.length("r.message.text").alias("message_chars"), F.size("r.fingerprints").alias("prints"),
    )


def source_tree(spark: SparkSession, root: str, max_bytes: int = 5_000_000, exclude: str | None = None) -> DataFrame:
    """path, language, lines of the text files under a folder: no binaries, decoded by byte-order mark, minified files left out.

    ``exclude`` is a regex on paths. Size limits prune at listing; a zero byte in the first 8192 marks a binary unless the
    file starts with a UTF-16 or UTF-32 mark.
    """
    from tracebed.operators.code import language_of

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    if exclude:
        files = files.where(~F.col("path").rlike(exclude))
    head = F.hex(F.substring("content", 1, 8192))
    wide = F.when(head.rlike("^(FFFE0000|0000FEFF)"), "UTF-32").when(head.rlike("^(FFFE|FEFF)"), "UTF-16")
    text = F.when(wide == "UTF-32", F.decode("content", "UTF-32")).when(wide == "UTF-16", F.decode("content", "UTF-16")).otherwise(F.regexp_replace(F.decode(F.col("content"), "UTF-8"), "^﻿", ""))
    binary = wide.isNull() & head.rlike("^(..)*?00")
    rows = files.where(~binary).select("path", text.alias("text")).select("path", F.split("text", "\r\n|\n|\r").alias("lines"), F.length("text").alias("n"))
    rows = rows.withColumn("lines", F.when(F.element_at("lines", -1) == "", F.slice("lines", 1, F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines")))
    minified = F.col("path").rlike(r"\.min\.(js|css)$") | ((F.size("lines") <= 3) & (F.col("n") > 5000)) | ((F.col("n") > 10000) & (F.col("n") / F.greatest(F.size("lines"), F.lit(1)) > 300))
    return rows.where(~minified).select("path", language_of(F.col("path")).alias("language"), "lines")

"""Flows from sources to sinks: queries over them, edges of attack paths, search, standards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracebed.functions.text import blank_free
from tracebed.operators.findings import glob_regex, normal_findings, severity_rank


@dataclass(frozen=True)
class FlowQuery:
    """A predicate on flow findings: globs on source, sink and endpoint, weaknesses, login, exposure, least score.

    ``login`` True asks for findings known to need a login; False takes those not known to. Exposure is compared as it
    is, unknown included; a missing score counts as 0.
    """

    id: str
    source: str = "*"
    sink: str = "*"
    endpoint: str = "*"
    cwe: tuple[str, ...] = ()
    login: bool | None = None
    exposed: bool | None = None
    least_score: float = 0.0

    def test(self) -> Column:
        out = F.coalesce(F.col("exploitability_score"), F.lit(0.0)) >= self.least_score
        for glob, column in ((self.source, "source_kind"), (self.sink, "sink_kind"), (self.endpoint, "endpoint")):
            if glob != "*":
                out = out & blank_free(F.col(column)).rlike(glob_regex(glob))
        if self.cwe:
            out = out & F.coalesce(F.arrays_overlap("cwe", F.array(*map(F.lit, self.cwe))), F.lit(False))
        if self.login is True:
            out = out & F.coalesce(F.col("authentication_required"), F.lit(False))
        if self.login is False:
            out = out & ~F.coalesce(F.col("authentication_required"), F.lit(False))
        if self.exposed is not None:
            out = out & F.col("internet_exposed").eqNullSafe(F.lit(self.exposed))
        return out


def flow_matches(scan: DataFrame, queries: list[FlowQuery]) -> DataFrame:
    """finding_no, queries: the ids of the queries each flow finding answers, in the queries' order, joined by commas.

    Queries are few and written into the plan: one pass, no cross join.
    """
    rows = normal_findings(scan, "tool", "source_kind", "sink_kind", "endpoint", "cwe", "authentication_required", "internet_exposed", "exploitability_score").where(F.contains(F.coalesce("tool", F.lit("")), F.lit("semantic")))
    ids = F.array_compact(F.array(*(F.when(q.test(), F.lit(q.id)) for q in queries)))
    return rows.select("finding_no", F.array_join(ids, ",").alias("queries")).where("queries <> ''")


def attack_edges(scan: DataFrame) -> DataFrame:
    """src, dst, kind, n: edges endpoint -> source kind -> sink kind -> file of findings that state them."""
    rows = normal_findings(scan, "endpoint", "source_kind", "sink_kind", "file")
    nodes = F.filter(
        F.array(
            *(F.struct(F.lit(kind).alias("kind"), F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(None)).alias("name")) for kind, c in (("endpoint", "endpoint"), ("source", "source_kind"), ("sink", "sink_kind"), ("file", "file")))
        ),
        lambda n: n["name"].isNotNull(),
    )
    chain = rows.select(nodes.alias("n")).where("size(n) > 1")
    edges = chain.select(F.explode(F.arrays_zip(F.slice("n", F.lit(1), F.size("n") - 1).alias("a"), F.slice("n", F.lit(2), F.size("n") - 1).alias("b"))).alias("e"))
    name = lambda x: F.concat_ws(":", F.col(f"e.{x}.kind"), F.col(f"e.{x}.name"))
    return edges.groupBy(name("a").alias("src"), name("b").alias("dst")).agg(F.count("*").alias("n"))


def report_search(scan: DataFrame, text: str, severity: str | None = None) -> DataFrame:
    """finding_no, severity_rank of the findings whose rule, file, message or category hold ``text``, letter case aside."""
    rows = normal_findings(scan, "rule_id", "file", "message", "category", "severity")
    whole = F.lower(F.concat_ws(" ", "rule_id", "file", "message", "category"))
    found = rows.where(F.contains(whole, F.lit(text.lower())))
    if severity:
        found = found.where(F.col("severity") == severity.upper())
    return found.select("finding_no", severity_rank(F.col("severity")).alias("severity_rank"))


def standards(scan: DataFrame, controls: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """standard, control, n, rules: findings under each control by their weaknesses, and the sorted rules that found them.

    ``controls`` maps a weakness to (standard, control) pairs; a finding counts once for a control.
    """
    rows = normal_findings(scan, "cwe", "rule_id")
    table = F.create_map(*(x for cwe, pairs in controls.items() for x in (F.lit(cwe), F.array(*(F.struct(F.lit(s).alias("standard"), F.lit(c).alias("control")) for s, c in pairs)))))
    hit = F.array_distinct(F.flatten(F.filter(F.transform("cwe", lambda c: F.try_element_at(table, c)), lambda x: x.isNotNull())))
    said = rows.select("finding_no", "rule_id", F.explode(hit).alias("c"))
    return said.groupBy("c.standard", "c.control").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))


def secret_clusters(scan: DataFrame) -> DataFrame:
    """place, n_findings, n_projects of each location that several secret findings name; paths in one spelling, each finding once."""
    rows = normal_findings(scan, "project", "category", "secret_related_locations").where("category = 'secret'")
    place = F.regexp_replace(F.regexp_extract("x", r"([^ ]+:[0-9]+)", 1), r"\\", "/")
    said = rows.select("finding_no", "project", F.explode("secret_related_locations").alias("x")).select("finding_no", "project", place.alias("place")).where("place <> ''").distinct()
    return said.groupBy("place").agg(F.count("*").alias("n_findings"), F.count_distinct("project").alias("n_projects")).where("n_findings > 1")

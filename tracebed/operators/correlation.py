"""Findings that tell of one defect: links by identity, place and kind, and one merged finding for each group."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tracebed.functions.text import blank_free
from tracebed.operators.components import connected
from tracebed.operators.findings import normal_findings, position_parts, problem_type, semantic_parts, severity_rank
from tracebed.session import Scratch

# fixed values: what place, weaknesses, type, source and sink weigh, the score from which two findings are one, that of equal spans, and that of equal identities
PLACE, WEAKNESS, TYPE, SOURCE, SINK = 0.28, 0.22, 0.22, 0.08, 0.08
LINKED, SAME_SPAN, SAME_IDENTITY = 0.72, 0.96, 1.0
# fixed values: lines between two spans that still are near, and how much of a full overlap that counts
NEAR_LINES, NEAR = 2, 0.5


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of two strings' letters in their common blocks, longest first."""
    return pd.Series([_likeness(x, y) for x, y in zip(a, b)], dtype="float64")


@lru_cache(maxsize=100_000)
def _likeness(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def _described(scan: DataFrame) -> DataFrame:
    """finding_no, name of the class of findings alike in all that is compared, and what is compared."""
    rows = normal_findings(scan, "file", "start_line", "end_line", "cwe", "category", "normalized_type", "rule_id", "source_kind", "sink_kind", "code_snippet", "fingerprint", "semantic_fingerprint").where("finding_no is not null")
    identity = lambda own, computed: F.coalesce(F.nullif(F.lower(F.trim(own)), F.lit("")), F.sha2(computed, 256))
    first = F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1))
    rows = rows.select(
        "finding_no",
        F.lower(F.coalesce("file", F.lit(""))).alias("path"),
        first.alias("lo"),
        F.greatest(first, F.coalesce("end_line", F.lit(1))).alias("hi"),
        F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("cwe", F.array().cast("array<string>")), F.trim), lambda c: c.isNotNull() & (c != "")))).alias("cwes"),
        blank_free(F.col("category")).alias("category"),
        problem_type(F.col("normalized_type"), F.col("cwe"), F.col("rule_id")).alias("kind"),
        blank_free(F.col("source_kind")).alias("source"),
        blank_free(F.col("sink_kind")).alias("sink"),
        identity(F.col("fingerprint"), position_parts()).alias("fp"),
        identity(F.col("semantic_fingerprint"), semantic_parts()).alias("sfp"),
    )
    # without a weakness only equal identities link, so these keep classes apart there
    alone = F.when(F.size("cwes") == 0, F.concat_ws("|", "fp", "sfp")).otherwise("")
    return rows.withColumn("name", F.md5(F.to_json(F.struct("path", "lo", "hi", "cwes", "category", "kind", "source", "sink", alone.alias("alone")))))


def _classes(described: DataFrame) -> DataFrame:
    """rep (the least finding_no) and what is compared, of each class."""
    return described.groupBy("name", "path", "lo", "hi", "cwes", "category", "kind", "source", "sink").agg(F.min("finding_no").alias("rep"), F.count("*").alias("n"))


def _side(classes: DataFrame, s: str) -> DataFrame:
    return classes.select("path", "c", "place", *(F.col(k).alias(f"{k}_{s}") for k in ("rep", "level", "lo", "hi", "cwes", "category", "kind", "source", "sink")))


def linked_classes(classes: DataFrame) -> DataFrame:
    """a, b, score of classes of one file that are one defect.

    A link needs a shared weakness and spans that overlap by two fifths or lie near, as nothing else scores enough; so pairs
    come from equi joins on file, weakness and place. Overlapping spans whose lengths differ by less than a factor of four
    meet in a cell of the longer one's size (three at most a span); near ones where one ends and the other starts. Only pairs
    that can score enough with the best likeness of types reach the likeness itself.
    """
    level = F.floor(F.log2(F.col("hi") - F.col("lo") + 1)).cast("int")
    each = classes.withColumn("level", level).withColumn("c", F.explode("cwes"))
    cells = lambda at: F.transform(F.sequence(F.expr(f"shiftright(lo, {at})"), F.expr(f"shiftright(hi, {at})")), lambda x: F.struct(F.expr(at).alias("size"), x.alias("at")))
    wide = each.withColumn("place", F.explode(F.flatten(F.array(cells("level"), cells("level + 1"), cells("level + 2")))))
    own = each.withColumn("place", F.explode(cells("level")))
    met = _side(wide, "x").join(_side(own, "y"), ["path", "c", "place"]).where("level_x < level_y or rep_x < rep_y")
    end = each.withColumn("place", F.explode(F.sequence(F.col("hi") + 1, F.col("hi") + NEAR_LINES)))
    near = _side(end, "x").join(_side(each.withColumn("place", F.col("lo")), "y"), ["path", "c", "place"])
    pairs = met.drop("place").unionByName(near.drop("place"))
    overlap = F.least("hi_x", "hi_y") - F.greatest("lo_x", "lo_y") + 1
    union = F.greatest("hi_x", "hi_y") - F.least("lo_x", "lo_y") + 1
    place = F.when(overlap > 0, overlap / union).when(1 - overlap <= NEAR_LINES, NEAR).otherwise(0.0)
    alike = F.size(F.array_intersect("cwes_x", "cwes_y")) / F.size(F.array_union("cwes_x", "cwes_y"))
    shared = lambda k: F.when((F.col(f"{k}_x") != "") & (F.col(f"{k}_x") == F.col(f"{k}_y")), 1.0).otherwise(0.0)
    same = (F.col("lo_x") == F.col("lo_y")) & (F.col("hi_x") == F.col("hi_y")) & (F.col("category_x") == F.col("category_y"))
    base = PLACE * place + WEAKNESS * alike + SOURCE * shared("source") + SINK * shared("sink")
    narrow = pairs.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"), base.alias("base"), same.alias("same"), F.when(F.col("rep_x") < F.col("rep_y"), F.col("kind_x")).otherwise(F.col("kind_y")).alias("ka"), F.when(F.col("rep_x") < F.col("rep_y"), F.col("kind_y")).otherwise(F.col("kind_x")).alias("kb"))
    narrow = narrow.where((F.col("base") + TYPE >= LINKED - 1e-6) | F.col("same")).distinct()
    score = F.when(F.col("same"), SAME_SPAN).otherwise(F.round(F.col("base") + TYPE * F.col("like"), 6))
    return narrow.withColumn("like", likeness("ka", "kb")).select("a", "b", score.alias("score")).where(F.col("score") >= LINKED)


def _star(rows: DataFrame, key: str) -> DataFrame:
    """a, b: each class linked to the least class of the same identity."""
    once = rows.select("rep", key).distinct()
    return once.join(once.groupBy(key).agg(F.min("rep").alias("b")), key).where("rep <> b").select(F.col("rep").alias("a"), "b")


def correlated_links(scan: DataFrame) -> DataFrame:
    """a, b, score: the least finding_no of either class, of classes of findings that tell of one defect in one place.

    Findings equal in file, span, weaknesses, category, type, source and sink are one class; null lines stand for line 1, a null
    file for no name, and rows without finding_no are left out. Links by equal identity aren't listed here.
    """
    described = Scratch(scan.sparkSession, "correlation").keep(_described(scan), "described")
    return linked_classes(_classes(described))


def correlated_findings(scan: DataFrame) -> DataFrame:
    """One row for each group of findings that tell of one defect, through links or equal identities, over any number of steps.

    group_no is the group's least finding_no, finding_no the first of the worst severity; engines and weaknesses are united;
    snippet_from, message_from name the finding whose snippet (the first there is, worst severity first) and message (the longest) count; what
    is unknown of the one is filled from the others, the greatest scores win. Lists are as long as there are engines or weaknesses.
    """
    scratch = Scratch(scan.sparkSession, "correlation")
    described = scratch.keep(_described(scan), "described")
    classes = scratch.keep(_classes(described), "classes")
    reps = scratch.keep(described.select("finding_no", "name", "fp", "sfp").join(classes.select("name", "rep"), "name").drop("name"), "reps")
    links = scratch.keep(linked_classes(classes), "links")
    group = connected(links.select("a", "b").unionByName(_star(reps, "fp")).unionByName(_star(reps, "sfp")))
    groups = scratch.keep(reps.join(group, reps.rep == group.node, "left").select("finding_no", "rep", F.coalesce("component", "rep").alias("group_no")), "groups")
    scored = links.select(F.col("a").alias("rep"), "score").unionByName(classes.where("n > 1 and size(cwes) > 0").select("rep", F.lit(SAME_SPAN).alias("score")))
    best = scored.join(groups.select("rep", "group_no").distinct(), "rep").groupBy("group_no").agg(F.max("score").alias("linked"))
    identical = groups.join(reps.select("finding_no", "sfp", "fp"), "finding_no")
    repeated = lambda k: identical.groupBy("group_no", k).agg(F.countDistinct("finding_no").alias("n")).where("n > 1").select("group_no")
    sure = repeated("fp").unionByName(repeated("sfp")).distinct().withColumn("sure", F.lit(SAME_IDENTITY))

    rows = normal_findings(scan, "severity", "tool", "detected_by", "cwe", "message", "code_snippet", "reachable", "exploitability_score", "confidence_score", "correlation_score").join(groups.select("finding_no", "group_no"), "finding_no")
    order = F.struct(severity_rank(F.col("severity")).alias("sr"), "finding_no")
    merged = rows.groupBy("group_no").agg(
        F.min(order)["finding_no"].alias("finding_no"),
        F.count("*").alias("n"),
        F.min(F.when(blank_free(F.col("code_snippet")) != "", order))["finding_no"].alias("snippet_from"),
        F.min(F.struct((-F.length(F.coalesce("message", F.lit("")))).alias("chars"), order.alias("o")))["o"]["finding_no"].alias("message_from"),
        F.min(F.when(F.col("reachable").isNotNull(), F.struct(order.alias("o"), "reachable")))["reachable"].alias("reachable"),
        F.max("exploitability_score").alias("exploitability_score"),
        F.max("confidence_score").alias("confidence_score"),
        F.max(F.coalesce("correlation_score", F.lit(0.0))).alias("own_score"),
    )
    by = F.when(F.size("detected_by") > 0, F.col("detected_by")).otherwise(F.array("tool"))
    united = lambda values, name: rows.select("group_no", F.explode(values).alias("x")).where("trim(x) <> ''").groupBy("group_no").agg(F.array_join(F.array_sort(F.collect_set(F.trim("x"))), ",").alias(name))
    out = merged.join(united(by, "engines"), "group_no", "left").join(united(F.col("cwe"), "cwes"), "group_no", "left").join(best, "group_no", "left").join(sure, "group_no", "left")
    score = F.greatest("own_score", F.coalesce("linked", F.lit(0.0)), F.coalesce("sure", F.lit(0.0)))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("group_no", "finding_no", "n", text("engines"), text("cwes"), "snippet_from", "message_from", "reachable", "exploitability_score", "confidence_score", score.alias("correlation_score"))

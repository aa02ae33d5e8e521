"""Duplicate regions of code: windows of lines, exact and near groups, merged regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracebed.operators.components import connected
from tracebed.session import Scratch

# fixed values: lines of a window, and the furthest its first and last line may lie apart
WINDOW, SPREAD = 6, 18
# fixed value: shared lines, over those of the larger of two blocks, from which they are near duplicates
NEAR_BLOCKS = 0.7
# fixed values: places and lines in all from which a group of duplicates is HIGH or MEDIUM
HIGH_GROUP, MEDIUM_GROUP = (5, 80), (3, 40)


def code_lines(lines: DataFrame) -> DataFrame:
    """file_no, line_no, token: each line once, hashes in small letters."""
    return lines.select("file_no", "line_no", F.lower(F.trim("token_hash")).alias("token")).where("token is not null").groupBy("file_no", "line_no").agg(F.min("token").alias("token"))


def line_windows(lines: DataFrame) -> DataFrame:
    """file_no, start_line, end_line, block: every window of WINDOW successive lines that aren't too far apart."""
    ahead = Window.partitionBy("file_no").orderBy("line_no")
    tokens = [F.col("token"), *(F.lead("token", i).over(ahead) for i in range(1, WINDOW))]
    wide = code_lines(lines).select("file_no", F.col("line_no").alias("start_line"), F.lead("line_no", WINDOW - 1).over(ahead).alias("end_line"), F.concat_ws("|", *tokens).alias("text"))
    return wide.where(F.col("end_line") - F.col("start_line") <= SPREAD).select("file_no", "start_line", "end_line", F.md5("text").alias("block"))


def exact_groups(blocks: DataFrame) -> DataFrame:
    """block_hash, n, n_files, first_file, first_line of each block that stands in two places or more.

    The primary place is the least (file_no, start_line). Whole rows repeated count once.
    """
    once = blocks.select("block_hash", "file_no", "start_line").where("block_hash is not null").distinct()
    groups = once.groupBy("block_hash").agg(F.count("*").alias("n"), F.min(F.struct("file_no", "start_line")).alias("first"))
    files = once.select("block_hash", "file_no").distinct().groupBy("block_hash").agg(F.count("*").alias("n_files"))
    return groups.where("n > 1").join(files, "block_hash").select("block_hash", "n", "n_files", F.col("first.file_no").alias("first_file"), F.col("first.start_line").alias("first_line"))


def duplicate_regions(blocks: DataFrame) -> DataFrame:
    """file_no, start_line, end_line: a file's duplicated blocks merged where they overlap or touch.

    Gaps and islands: a region starts where no earlier block reaches.
    """
    once = blocks.select("block_hash", "file_no", "start_line", "end_line").where("block_hash is not null").distinct()
    many = once.groupBy("block_hash").agg(F.min(F.struct("file_no", "start_line")).alias("lo"), F.max(F.struct("file_no", "start_line")).alias("hi")).where("lo <> hi").select("block_hash")
    spans = once.join(many, "block_hash", "left_semi").select("file_no", "start_line", "end_line").distinct()
    by_file = Window.partitionBy("file_no").orderBy("start_line", "end_line")
    reach = F.max("end_line").over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.when(reach.isNull() | (F.col("start_line") > reach + 1), 1).otherwise(0))
    numbered = opened.withColumn("region", F.sum("opens").over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("file_no", "region").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("region")


def near_file_pairs(lines: DataFrame, least: float = 0.3) -> DataFrame:
    """a, b, shared, overlap of files that share lines: shared lines over those of the smaller file, every line counting.

    Files with equal sets of lines are one class, compared once and written out as pairs at the end. Lines stand in one
    order, rare ones first: to share ``least`` of its n lines a class must share one of its first n - ceil(least * n) + 1,
    so only these are joined with the lines of the larger classes; overlaps are then counted exactly.
    """
    scratch = Scratch(lines.sparkSession, "near")
    files = code_lines(lines).where("file_no is not null").groupBy("file_no").agg(F.array_sort(F.collect_set("token")).alias("w"))
    files = scratch.keep(files.withColumn("name", F.sha2(F.array_join("w", "|"), 256)), "files")
    classes = files.groupBy("name").agg(F.min("file_no").alias("rep"), F.min_by("w", "file_no").alias("w"), F.count("*").alias("files"))
    classes = scratch.keep(classes, "classes")
    members = files.select("file_no", "name").join(classes.select("name", "rep"), "name").select("rep", "file_no")
    each = classes.select("rep", F.explode("w").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("f"))
    ordered = each.join(counts, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("w"))
    posted = ordered.select("rep", F.size("w").alias("n"), F.posexplode("w").alias("pos", "t")).where("t.f > 1").select(F.col("t.token").alias("token"), "rep", "n", "pos")
    posted = scratch.keep(posted, "postings")
    # overlaps are rounded to six places before they are compared
    enough = lambda n: F.ceil((least - 5e-7) * n - 1e-9)
    small = posted.where(F.col("pos") <= F.col("n") - enough(F.col("n"))).select("token", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"))
    large = posted.select("token", F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"))
    proposed = (
        small.join(large, "token")
        .where(F.struct("nx", "x") < F.struct(F.col("ny").alias("nx"), F.col("y").alias("x")))
        .where(F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= enough(F.col("nx")))
        .select("x", "y")
        .distinct()
    )
    sets = classes.select("rep", "w")
    both = proposed.join(sets.select(F.col("rep").alias("x"), F.col("w").alias("wx")), "x").join(sets.select(F.col("rep").alias("y"), F.col("w").alias("wy")), "y")
    counted = both.select("x", "y", F.size(F.array_intersect("wx", "wy")).cast("long").alias("shared"), F.size("wx").alias("n"))
    same = classes.where("files > 1").select(F.col("rep").alias("x"), F.col("rep").alias("y"), F.size("w").cast("long").alias("shared"), F.size("w").alias("n"))
    alike = counted.unionByName(same).select("x", "y", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("overlap")).where(F.col("overlap") >= least)
    pairs = alike.join(members.select(F.col("rep").alias("x"), F.col("file_no").alias("f")), "x").join(members.select(F.col("rep").alias("y"), F.col("file_no").alias("g")), "y")
    return pairs.where("x <> y or f < g").select(F.least("f", "g").alias("a"), F.greatest("f", "g").alias("b"), "shared", "overlap")


def _block_places(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """name of a block's set of lines, w, file_no, start_line, end_line: each place once."""
    tokens = F.array_sort(F.array_distinct(F.filter(F.transform("token_hashes", lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != ""))))
    once = blocks.where("file_no is not null and start_line is not null").select("file_no", "start_line", F.coalesce("end_line", F.col("start_line")).alias("end_line"), tokens.alias("w")).where("size(w) > 0")
    return scratch.keep(once.groupBy("file_no", "start_line", "end_line").agg(F.min("w").alias("w")).withColumn("name", F.md5(F.array_join("w", "|"))), "places")


def _near_classes(places: DataFrame, scratch: Scratch, least: float) -> DataFrame:
    """x, y: names of sets of lines that share ``least`` of the larger's lines and have places apart.

    Places are apart in different files, or where one ends before the other starts. With rare lines first, one of the first
    n - ceil(least * n) + 1 of each set's n lines must be shared, so only these are joined. A set is paired with itself
    where two of its places are apart.
    """
    bounds = [F.min("file_no").alias("f0"), F.max("file_no").alias("f1"), F.min("end_line").alias("ends"), F.max("start_line").alias("starts")]
    classes = scratch.keep(places.groupBy("name").agg(F.any_value("w").alias("w"), *bounds), "classes")
    each = classes.select("name", F.explode("w").alias("token"))
    rarity = each.groupBy("token").agg(F.count("*").alias("f"))
    ordered = each.join(rarity, "token").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("o"))
    enough = lambda n: F.ceil(least * n - 1e-9)
    first = F.slice("o", F.lit(1), (F.size("o") - enough(F.size("o")) + 1).cast("int"))
    posted = ordered.select("name", F.explode(first).alias("t")).where("t.f > 1").select("name", F.col("t.token").alias("token")).join(classes.drop("w"), "name")
    posted = scratch.keep(posted, "postings")
    side = lambda df, k: df.select(*(F.col(c).alias(c if c == "token" else k if c == "name" else f"{c}_{k}") for c in df.columns))
    apart = (F.col("f0_x") != F.col("f1_x")) | (F.col("f0_y") != F.col("f1_y")) | (F.col("f0_x") != F.col("f0_y")) | (F.col("ends_x") < F.col("starts_y")) | (F.col("ends_y") < F.col("starts_x"))
    proposed = side(posted, "x").join(side(posted, "y"), "token").where("x < y").where(apart).select("x", "y").distinct()
    sets = classes.select("name", "w")
    both = proposed.join(side(sets, "x"), "x").join(side(sets, "y"), "y")
    near = both.where(F.size(F.array_intersect("w_x", "w_y")) >= enough(F.greatest(F.size("w_x"), F.size("w_y")))).select("x", "y")
    return near.unionByName(classes.where("f0 <> f1 or ends < starts").select(F.col("name").alias("x"), F.col("name").alias("y")))


def duplicate_findings(blocks: DataFrame, least: float = NEAR_BLOCKS) -> DataFrame:
    """file_no, start_line, end_line, severity, n, primary_file, primary_line: regions of a file that duplicate another place.

    Blocks with equal sets of lines are one class; classes near to each other (see ``_near_classes``) form groups over any number of
    steps. All places of a group but its first tell of a duplicate; those that overlap or touch in a file become one region with the
    severity, size and first place of the one that starts it. Rows without file, start or lines are left out; repeated rows count once.
    """
    scratch = Scratch(blocks.sparkSession, "duplicates")
    places = _block_places(blocks, scratch)
    near = scratch.keep(_near_classes(places, scratch, least), "near")
    grouped = connected(near, "x", "y")
    alone = near.where("x = y").select(F.col("x").alias("node"), F.col("x").alias("component")).join(grouped, "node", "left_anti")
    found = scratch.keep(places.join(grouped.unionByName(alone), F.col("name") == F.col("node")).select("component", "file_no", "start_line", "end_line"), "grouped")
    sizes = found.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"), F.min(F.struct("file_no", "start_line", "end_line")).alias("first"))
    beyond = lambda bounds: (F.col("n") >= bounds[0]) | (F.col("lines") >= bounds[1])
    severity = F.when(beyond(HIGH_GROUP), "HIGH").when(beyond(MEDIUM_GROUP), "MEDIUM").otherwise("LOW")
    told = found.join(sizes.withColumn("severity", severity), "component").where(F.struct("file_no", "start_line", "end_line") != F.col("first"))
    by_file = Window.partitionBy("file_no").orderBy("start_line", "end_line")
    reach = F.max("end_line").over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    opened = told.withColumn("opens", F.when(reach.isNull() | (F.col("start_line") > reach + 1), 1).otherwise(0))
    regions = opened.withColumn("region", F.sum("opens").over(by_file.rowsBetween(Window.unboundedPreceding, 0))).groupBy("file_no", "region")
    start = F.struct("start_line", F.col("end_line").alias("e"), "severity", "n", F.col("first.file_no").alias("f"), F.col("first.start_line").alias("l"))
    merged = regions.agg(F.min(start).alias("s"), F.max("end_line").alias("end_line"))
    return merged.select("file_no", "s.start_line", "end_line", "s.severity", "s.n", F.col("s.f").alias("primary_file"), F.col("s.l").alias("primary_line"))

"""Long exact spans shared between files, by compacting the graph of repeated token k-mers.

A line's token hash is one token; k successive lines of a file are a k-mer, an edge from its first k-1 tokens to
its last k-1. Edges seen in two files or more form a graph whose non-branching paths are compacted into unitigs with
joins; the unitig's coordinates are then laid back over the source lines, where they are verified token by token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracebed.operators.hierarchy import solve_forest
from tracebed.session import Scratch

#: rows of a file that one task numbers or windows at a time; a longer file is spread over several
BLOCK = 4096


def numbered_lines(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """file_no, line_no, token, pos: the rows of each file, each line once, numbered 0, 1, ... by line_no.

    A line delivered twice counts once; token hashes are compared without letter case and outer blanks, and where
    copies of a line disagree the least present one counts. A missing hash gives a null token, which equals nothing.
    Rows without file or line number are left out. Numbers come from per-block counts, so that one long file does
    not end in one task.
    """
    token = F.nullif(F.lower(F.trim("token_hash")), F.lit(""))
    once = (
        lines.where("file_no is not null and line_no is not null")
        .select("file_no", "line_no", F.xxhash64(token).alias("token"), token.isNull().alias("missing"))
        .groupBy("file_no", "line_no")
        .agg(F.min(F.when(~F.col("missing"), F.col("token"))).alias("token"))
        .withColumn("block", F.floor(F.col("line_no") / BLOCK))
    )
    once = scratch.keep(once, "lines")
    sizes = once.groupBy("file_no", "block").agg(F.count("*").alias("n"))
    before = sizes.select("file_no", "block", (F.sum("n").over(Window.partitionBy("file_no").orderBy("block")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file_no", "block").orderBy("line_no")) - 1
    return once.withColumn("inside", inside).join(before, ["file_no", "block"]).select("file_no", "line_no", "token", (F.col("before") + F.col("inside")).alias("pos"))


def kmers(numbered: DataFrame, k: int) -> DataFrame:
    """file_no, pos, k1, k2 (128 bits of the k tokens from pos on) and those of the first and last k-1.

    Each block of positions is windowed with the k-1 rows that follow it; a window that is short or holds a
    missing token is no k-mer.
    """
    place = F.floor(F.col("pos") / BLOCK)
    # the first k-1 rows of a block also go to the block before
    homes = F.when((F.col("pos") % BLOCK < k - 1) & (place > 0), F.array(place, place - 1)).otherwise(F.array(place))
    spread = numbered.select("file_no", "pos", "token", F.explode(homes).alias("home"))
    ahead = Window.partitionBy("file_no", "home").orderBy("pos")
    cols = [F.col("token"), *(F.lead("token", i).over(ahead) for i in range(1, k))]
    wide = spread.select("file_no", "pos", "home", *(c.alias(f"t{i}") for i, c in enumerate(cols)))
    whole = wide.where(F.floor(F.col("pos") / BLOCK) == F.col("home")).dropna(subset=[f"t{i}" for i in range(k)])
    tokens = [f"t{i}" for i in range(k)]
    two = lambda part, name: (F.xxhash64(*part).alias(f"{name}1"), F.xxhash64(F.lit(name), *reversed(part)).alias(f"{name}2"))
    node = lambda part, name: (F.xxhash64(*part).alias(f"{name}1"), F.xxhash64(F.lit("node"), *reversed(part)).alias(f"{name}2"))
    return whole.select("file_no", "pos", *two(tokens, "k"), *node(tokens[:-1], "p"), *node(tokens[1:], "s"))


def unitigs(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, unitig, offset of each repeated edge: where it lies on its non-branching path.

    An edge follows another when the node between them has one edge in and one out. Chains are numbered by the
    pointer solver; a path that closes on itself has no first edge, so each of its edges stands alone.
    """
    out = edges.groupBy("p1", "p2").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    into = edges.groupBy("s1", "s2").agg(F.count("*").alias("n"), F.min("id").alias("parent")).where("n = 1").drop("n")
    links = out.join(into, (F.col("p1") == F.col("s1")) & (F.col("p2") == F.col("s2"))).select("id", "parent")
    chained = edges.select("id").join(links, "id", "left").select("id", "parent", F.xxhash64("id").alias("splitter_hash"))
    solved = solve_forest(scratch.keep(chained, "chain"), scratch)
    return solved.select("id", F.coalesce("root", "id").alias("unitig"), F.when(F.col("root").isNull(), 0).otherwise(F.col("depth")).alias("offset"))


def shared_spans(lines: DataFrame, min_rows: int = 10, scratch: Scratch | None = None, numbered: DataFrame | None = None) -> DataFrame:
    """file_no, unitig, unitig_offset, start_pos, n_rows: stretches of files that lie on a unitig, verified.

    Every run of at least ``min_rows`` successive rows that another file holds too is covered by these spans and
    nothing else is. Copies within one file alone don't count. Empty input gives no rows.
    """
    scratch = scratch or Scratch(lines.sparkSession, "spans")
    numbered = numbered_lines(lines, scratch) if numbered is None else numbered
    grams = scratch.keep(kmers(numbered, min_rows), "kmers")
    # partial aggregation first: a header that a third of all files share arrives as one row per task
    repeated = (
        grams.groupBy("k1", "k2")
        .agg(F.min("file_no").alias("lo"), F.max("file_no").alias("hi"), *(F.min(c).alias(c) for c in ("p1", "p2", "s1", "s2")))
        .where("lo <> hi")
        .select("k1", "k2", "p1", "p2", "s1", "s2", F.monotonically_increasing_id().alias("id"))
    )
    edges = scratch.keep(repeated, "edges")
    where = unitigs(edges, scratch)
    placed = edges.select("k1", "k2", "id").join(where, "id").select("k1", "k2", "unitig", "offset")
    seen = grams.select("file_no", "pos", "k1", "k2").join(placed, ["k1", "k2"]).select("file_no", "pos", "unitig", "offset")
    # along one file and one unitig, pos - offset is constant while the text follows the path
    block = F.floor(F.col("pos") / BLOCK)
    run = Window.partitionBy("file_no", "unitig", "diagonal", "block").orderBy("pos")
    stretches = (
        seen.select("file_no", "unitig", "offset", "pos", (F.col("pos") - F.col("offset")).alias("diagonal"), block.alias("block"))
        .withColumn("island", F.col("pos") - F.row_number().over(run))
        .groupBy("file_no", "unitig", "diagonal", "block", "island")
        .agg(F.min("pos").alias("start_pos"), F.min("offset").alias("unitig_offset"), (F.max("pos") - F.min("pos") + min_rows).alias("n_rows"))
    )
    spans = scratch.keep(stretches.select("file_no", "unitig", "unitig_offset", "start_pos", "n_rows"), "spans")
    # verification in source coordinates: all rows at one place of a unitig must hold one token
    at = spans.select("file_no", "unitig", "start_pos", F.posexplode(F.sequence("start_pos", F.col("start_pos") + F.col("n_rows") - 1)).alias("i", "pos"), "unitig_offset")
    tokens = at.join(numbered.select("file_no", "pos", "token"), ["file_no", "pos"])
    wrong = (
        tokens.groupBy("unitig", (F.col("unitig_offset") + F.col("i")).alias("place"))
        .agg(F.min("token").alias("lo"), F.max("token").alias("hi"))
        .where("lo <> hi")
        .select("unitig")
        .distinct()
    )
    return spans.join(wrong, "unitig", "left_anti")


def shared_lines(lines: DataFrame, min_rows: int = 10) -> DataFrame:
    """file_no, line_no of each row that lies in a run of at least ``min_rows`` rows another file holds too."""
    scratch = Scratch(lines.sparkSession, "spans")
    numbered = scratch.keep(numbered_lines(lines, scratch), "numbered")
    spans = shared_spans(lines, min_rows, scratch, numbered)
    pos = spans.select("file_no", F.explode(F.sequence("start_pos", F.col("start_pos") + F.col("n_rows") - 1)).alias("pos")).distinct()
    return numbered.join(pos, ["file_no", "pos"]).select("file_no", "line_no")


def shared_share(lines: DataFrame, min_rows: int = 10) -> DataFrame:
    """file_no, n_lines, n_shared, share: how much of each file occurs elsewhere."""
    scratch = Scratch(lines.sparkSession, "spans")
    numbered = scratch.keep(numbered_lines(lines, scratch), "numbered")
    spans = shared_spans(lines, min_rows, scratch, numbered)
    pos = spans.select("file_no", F.explode(F.sequence("start_pos", F.col("start_pos") + F.col("n_rows") - 1)).alias("pos")).distinct()
    marked = numbered.join(pos.withColumn("shared", F.lit(1)), ["file_no", "pos"], "left")
    return marked.groupBy("file_no").agg(
        F.count("*").alias("n_lines"), F.count("shared").alias("n_shared"), F.round(F.count("shared") / F.count("*"), 6).alias("share")
    )

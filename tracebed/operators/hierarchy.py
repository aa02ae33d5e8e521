"""Parent-child rows to full hierarchies, by hash splitters.

Every node has at most one parent. A hash of the node decides whether it is a splitter. Each node walks to its
next splitter or root, several steps at a time; the splitters alone form a far smaller pointer graph, which is
solved next; the exact paths between splitters then expand its answers to all nodes. Nodes that meet no splitter
at all hang on a cycle without one and are told apart by the set their walks settle in.

All work is joins and grouped sums over node ids, so depth costs rounds by its logarithm and no node's
descendants are ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tracebed.functions.text import plain_path
from tracebed.session import Scratch


#: rows of one file of a round's table: late rounds are small, and a file costs a task in every later round
PART = 200_000


def _jump(scratch: Scratch, start: DataFrame, lists: list[str], sums: list[str], name: str) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """Pointer doubling over (id, nxt, stop, ...) until every row stops or is known to go round for ever.

    ``stop`` says that ``nxt`` is a place to stop at. Columns in ``sums`` add up along the way, those in ``lists``
    concatenate. Returns all stopped rows, the ids that lie on a cycle (None where every row stopped) and for each round
    the rows that had not stopped, which have made exactly 2**round steps. A row is written once, when it stops, and
    else only while it still moves.

    Going round is proved, not guessed: when a round stops no further row, none is left that could, because a walk
    of length L over 2**(j-1) always has a row with its stop between 2**(j-1) and 2**j steps; and when the places
    that the rest stand on have become no fewer, a jump permutes them, so they are the cycles.
    """
    done, live, rounds = start.where("stop"), start.where("not stop"), []
    left = live.count()
    while left:
        rounds.append(live)
        ahead = done.unionByName(live).select(F.col("id").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("stop").alias("stop2"), *(F.col(c).alias(f"{c}2") for c in lists + sums))
        moved = live.join(ahead, "nxt").select(
            "id",
            F.col("nxt2").alias("nxt"),
            F.col("stop2").alias("stop"),
            *((F.concat(c, f"{c}2") if c in lists else F.col(c) + F.col(f"{c}2")).alias(c) for c in lists + sums),
        )
        seen = Observation()
        moved = moved.repartition(-(-left // PART)).observe(seen, F.count_if(~F.col("stop")).alias("n"))
        moved = scratch.keep(moved, f"{name}-{len(rounds)}")
        before, left, live = left, seen.get["n"], moved.where("not stop")
        done = done.unionByName(moved.where("stop").select(done.columns))
        if left and left == before:
            places = [t.select("nxt").distinct().count() for t in (rounds[-1], live)]
            if places[0] == places[1]:
                return done, live.select(F.col("nxt").alias("id")).distinct(), rounds
    return done, None, rounds


def solve_forest(nodes: DataFrame, scratch: Scratch, splitter_every: int = 16, with_paths: bool = False) -> DataFrame:
    """Root, depth and number of descendants of every node of a parent-pointer graph.

    ``nodes`` has id BIGINT (unique), parent BIGINT (null for a root, else an id of the table) and splitter_hash
    BIGINT; other columns are ignored. Returns id, root, depth, n_descendants: on a circle root is null and both
    numbers -1, leading into one null, -2 and -1. With ``with_paths`` also path, the ids from the node to its root, both
    included (null off the forest); its total size is the sum of depths, which the answer itself has.
    """
    nodes = nodes.select("id", "parent", (F.pmod("splitter_hash", F.lit(splitter_every)) == 0).alias("split"))
    stops = nodes.select(F.col("id").alias("nxt"), (F.col("split") | F.col("parent").isNull()).alias("stop"))
    first = (
        nodes.where("parent is not null")
        .select("id", F.col("parent").alias("nxt"))
        .join(stops, "nxt")
        .select("id", "nxt", "stop", F.lit(1).alias("steps"), F.array("nxt").alias("hops"))
    )
    walked, circles, _ = _jump(scratch, scratch.keep(first, "walk-0"), ["hops"], ["steps"], "walk")
    walked = scratch.keep(walked, "walked")

    # the reduced graph: splitters that aren't roots, pointing at the next splitter or root
    kind = nodes.select("id", "split", F.col("parent").isNull().alias("is_root"))
    passed = walked.groupBy("nxt").agg(F.count("*").alias("n"))
    reduced_first = (
        walked.join(kind.where("split and not is_root").select("id"), "id", "left_semi")
        .join(kind.select(F.col("id").alias("nxt"), F.col("is_root").alias("at_root")), "nxt")
        .join(passed.select(F.col("nxt").alias("id"), "n"), "id", "left")
        .select("id", "nxt", F.col("at_root").alias("stop"), F.col("steps").cast("long").alias("depth"), "hops", F.coalesce("n", F.lit(0)).alias("n"))
    )
    # a splitter whose next stop lies before a splitterless circle can't exist: that walk never stops, nor does its own
    reduced_first = scratch.keep(reduced_first, "reduced-0")
    lists = ["hops"] if with_paths else []
    reduced, reduced_circles, rounds = _jump(scratch, reduced_first.select("id", "nxt", "stop", "depth", *lists), lists, ["depth"], "reduced")

    # subtree sums of the reduced forest: after round j a sum covers all splitters less than 2**j steps below
    sums = reduced_first.select("id", "n")
    for table in rounds:
        below = table.join(sums, "id").groupBy(F.col("nxt").alias("id")).agg(F.sum("n").alias("more"))
        sums = scratch.keep(sums.join(below, "id", "left").select("id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "sums")

    solved = reduced.select("id", F.col("nxt").alias("root"), "depth", *(F.col(c).alias("upper") for c in lists))
    stop_kind = kind.where("split or is_root").select(F.col("id").alias("nxt"), F.col("is_root").alias("at_root"))
    # one row per stop: what a walk that ends there goes on with
    onward = stop_kind.join(solved.withColumnRenamed("id", "nxt"), "nxt", "left").select(
        "nxt",
        F.when(F.col("at_root"), F.col("nxt")).otherwise(F.col("root")).alias("root"),
        F.when(F.col("at_root"), F.lit(0).cast("long")).otherwise(F.col("depth")).alias("above"),
        *(F.coalesce(F.col("upper"), F.array().cast("array<bigint>")).alias("upper") for _ in lists),
    )
    placed = walked.join(onward, "nxt").select(
        "id", "root", (F.col("steps") + F.col("above")).alias("depth"), *(F.concat(F.array("id"), "hops", "upper").alias("path") for _ in lists)
    )

    # descendants: inside a walk each node passes itself and, at a splitter, all that hangs below it
    weights = walked.join(sums, "id", "left").select("hops", (F.lit(1) + F.coalesce("n", F.lit(0))).alias("w"))
    inner = weights.select(F.explode(F.slice("hops", F.lit(1), F.size("hops") - 1)).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("n"))
    whole = placed.where("root is not null").groupBy(F.col("root").alias("id")).agg(F.count("*").alias("n"))
    below = inner.unionByName(sums).unionByName(whole)

    forest = nodes.where("parent is null").select(
        "id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), *(F.array("id").alias("path") for _ in lists)
    ).unionByName(placed)
    out = forest.join(below.groupBy("id").agg(F.sum("n").alias("n_descendants")), "id", "left")
    circle_ids = None
    if reduced_circles is not None:
        on = reduced_first.join(reduced_circles, "id", "left_semi")
        circle_ids = on.select(F.explode("hops").alias("id")).distinct()
    if circles is not None:
        circle_ids = circles if circle_ids is None else circle_ids.unionByName(circles).distinct()
    rest = nodes.where("parent is not null").select("id").join(forest.where("root is not null").select("id"), "id", "left_anti")
    if circle_ids is None:
        return out.select("id", "root", F.col("depth").cast("int"), F.coalesce("n_descendants", F.lit(0)).cast("int").alias("n_descendants"), *(["path"] if with_paths else []))
    lost = rest.join(circle_ids.withColumn("on_circle", F.lit(True)), "id", "left").select(
        "id", F.lit(None).cast("long").alias("root"), F.when(F.col("on_circle"), -1).otherwise(-2).cast("long").alias("depth"), F.lit(-1).cast("long").alias("n_descendants"), *(F.lit(None).cast("array<bigint>").alias("path") for _ in lists)
    )
    found = out.where("root is not null").unionByName(lost)
    return found.select("id", "root", F.col("depth").cast("int"), F.coalesce("n_descendants", F.lit(0)).cast("int").alias("n_descendants"), *(["path"] if with_paths else []))


def dependency_nodes(dependencies: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, file, parent, splitter_hash) of every file named in either column, paths in one spelling.

    Rows of a file with itself are left out of the links (the file is still named); of the others the latest
    recorded_at counts, a null time before any other, ties by the greater depends_on. Rows with a null or blank
    file name only their depends_on. Ids are numbers given once and written, so that every later read agrees.
    """
    rows = dependencies.select(plain_path(F.col("file")).alias("file"), plain_path(F.col("depends_on")).alias("depends_on"), "recorded_at")
    rows = scratch.keep(rows, "rows")
    named = rows.select("file").unionByName(rows.select(F.col("depends_on").alias("file"))).where("file is not null").distinct()
    named = scratch.keep(named.select("file", F.monotonically_increasing_id().alias("id")), "named")
    latest = (
        rows.where("file is not null and (depends_on is null or depends_on <> file)")
        .groupBy("file")
        .agg(F.max(F.struct("recorded_at", "depends_on"))["depends_on"].alias("depends_on"))
        .where("depends_on is not null")
    )
    parents = latest.join(named.select(F.col("file").alias("depends_on"), F.col("id").alias("parent")), "depends_on").select("file", "parent")
    return scratch.keep(named.join(parents, "file", "left").select("id", "file", "parent", F.xxhash64("file").alias("splitter_hash")), "nodes")


def dependency_hierarchy(dependencies: DataFrame, with_paths: bool = False, splitter_every: int = 16) -> DataFrame:
    """file, root, depth, n_descendants of each file (and path, the files up to the root, with ``with_paths``).

    Off the forest root is '', n_descendants -1 and depth -1 (on a circle) or -2 (leading into one). An empty table gives no
    rows; other columns, whatever their names, are ignored.
    """
    scratch = Scratch(dependencies.sparkSession, "hierarchy")
    nodes = dependency_nodes(dependencies, scratch)
    solved = solve_forest(nodes, scratch, splitter_every, with_paths)
    names = nodes.select("id", "file")
    out = solved.join(names, "id").join(names.select(F.col("id").alias("root"), F.col("file").alias("root_file")), "root", "left")
    if not with_paths:
        return out.select("file", F.coalesce("root_file", F.lit("")).alias("root"), "depth", "n_descendants")
    steps = solved.select("id", F.posexplode("path").alias("pos", "step"))
    spelt = steps.join(names.select(F.col("id").alias("step"), F.col("file").alias("step_file")), "step")
    paths = spelt.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "step_file"))), lambda s: s["step_file"]).alias("path"))
    return out.join(paths, "id", "left").select("file", F.coalesce("root_file", F.lit("")).alias("root"), "depth", "n_descendants", paths["path"].alias("path"))


def dependents(dependencies: DataFrame, splitter_every: int = 16) -> DataFrame:
    """One row for each file and each file that depends on it, directly or through others, with the distance.

    Covers the forest; files on or leading into a circle have no defined set here and are left out.
    """
    scratch = Scratch(dependencies.sparkSession, "dependents")
    nodes = dependency_nodes(dependencies, scratch)
    solved = solve_forest(nodes, scratch, splitter_every, with_paths=True)
    names = nodes.select("id", "file")
    pairs = solved.select(F.col("id").alias("below"), F.posexplode("path").alias("distance", "id")).where("distance > 0")
    return (
        pairs.join(names, "id")
        .join(names.select(F.col("id").alias("below"), F.col("file").alias("dependent")), "below")
        .select("file", "dependent", F.col("distance").cast("int").alias("distance"))
    )

"""Judging new batches of findings against all that was accepted before, by content-defined chunks.

A hash that rolls from word to word sets the boundaries of a snippet's chunks, so that an edit changes the chunks it
touches and no others. A persistent table maps chunks to accepted records; the bytes two snippets share in chunks decide
by coverage which are compared, and what is accepted is appended. Chunks alone can't find every pair of like word sets
(words may stand in another order), so what they leave undecided is looked up once more by its rarest words, which no like
pair can be without. An exact comparison of word sets has the last word. The tables are bucketed by their join
keys, so a batch shuffles itself and never the history.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebed.functions.text import present, utc_time
from tracebed.session import Scratch

MIN_WORDS = 10
MIN_SIMILARITY = 0.7
#: share of the larger snippet's bytes in common chunks from which two snippets are compared
MIN_COVERAGE = 0.5
#: one word in so many ends a chunk
CHUNK_WORDS = 3
#: rows up to which small batches are judged together, as one run
RUN_ROWS = 50_000
#: rows (keys of undecided records and like pairs) up to which one task settles them in order, without rounds
SETTLE_ROWS = 200_000
#: tokens whose frequency is kept for the common order, the most frequent; all others come first in it
ORDER_SIZE = 50_000

_LINE_NUMBER = re.compile(r"^[ \t]*\d+:", re.M)
_WORD = re.compile(r"\w+")
_IDS = pa.list_(pa.int64())


def _texts_words(snippet: str | None) -> list[str]:
    return _WORD.findall(_LINE_NUMBER.sub("", snippet or "").lower())


def snippet_words(snippet: str | None) -> set[str]:
    """Lower-cased runs of letters, digits and underscores, line-number prefixes left out."""
    return set(_texts_words(snippet))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def snippet_features(snippet: str | None) -> dict | None:
    """The word set's name, its words and chunks, None with less than MIN_WORDS words.

    Words are 64-bit names. A chunk is 47 bits of the hash of its words and 16 of its size in bytes; equal chunks of one
    snippet count once.
    """
    import xxhash

    text = _texts_words(snippet)
    sizes = {w: w.encode("utf-8", "surrogatepass") for w in text}
    if len(sizes) < MIN_WORDS:
        return None
    ids = {w: xxhash.xxh64_intdigest(b) for w, b in sizes.items()}
    chunks, h, size = set(), 0, 0
    for w in text:
        h, size = (h * 0x9E3779B97F4A7C15 + ids[w]) & 0xFFFFFFFFFFFFFFFF, size + len(sizes[w]) + 1
        if ids[w] % CHUNK_WORDS == 0:
            chunks.add((h >> 17) << 16 | min(size, 0xFFFF))
            h = size = 0
    if size:
        chunks.add((h >> 17) << 16 | min(size, 0xFFFF))
    return {"cls": xxhash.xxh3_128_digest(b"\0".join(sorted(sizes.values()))), "words": sorted(map(_signed, ids.values())), "chunks": sorted(chunks)}


def with_features(rows: DataFrame) -> DataFrame:
    """The rows with cls (the 128-bit name of the word set, null for a short one), words and chunks.

    Copies of one word set within a task and batch carry words and chunks once, with the first of them: a set that a
    third of all rows share leaves each task as one row. The snippet itself, the last column, is dropped.
    """
    keep = rows.columns[:-1]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            out = []
            for no, snippet in zip(batch.column(1).to_pylist(), batch.column(len(keep)).to_pylist()):
                found = snippet_features(snippet)
                key = found and (no, found["cls"])
                if found is None:
                    out.append((None, None, None))
                elif key in seen:
                    out.append((found["cls"], None, None))
                else:
                    if len(seen) < 1_000_000:  # beyond that copies only cost time
                        seen.add(key)
                    out.append((found["cls"], found["words"], found["chunks"]))
            columns = list(zip(*out)) if out else [[]] * 3
            types = (pa.binary(), _IDS, _IDS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(list(c), t) for c, t in zip(columns, types))], names=[*keep, "cls", "words", "chunks"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(compute, f"{fields}, cls binary, words array<bigint>, chunks array<bigint>")


def common_order(sets: DataFrame) -> DataFrame:
    """t, n: the ORDER_SIZE tokens (words and chunks) that most of the sets hold, counted over all sets.

    Any order finds every pair, if it is the same for all that is compared; rare tokens first propose the fewest.
    """
    counted = sets.select(F.explode(F.concat("words", "chunks")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return counted.where("n > 1").orderBy(F.desc("n"), "t").limit(ORDER_SIZE)


def leading_words(ordered: list[int]) -> list[int]:
    """The words of a set, rare ones first, that a set like it must share one of."""
    n = len(ordered)
    return ordered[: n - math.ceil(MIN_SIMILARITY * n - 1e-6) + 1]


def leading_chunks(ordered: list[int]) -> list[int]:
    """The chunks, rare ones first, that a snippet with MIN_COVERAGE must share one of: from the others on too few bytes are left."""
    left = whole = sum(c & 0xFFFF for c in ordered)
    out = []
    for c in ordered:
        if left < MIN_COVERAGE * whole - 1e-6:
            break
        out.append(c)
        left -= c & 0xFFFF
    return out


def with_leading(sets: DataFrame, order: DataFrame) -> DataFrame:
    """rec, batch_no, cls, words (32 bits each), chunks, lead_chunks and lead_words, the tokens that are looked up.

    The order has ORDER_SIZE rows at most, which is what is broadcast.
    """
    shared = sets.sparkSession.sparkContext.broadcast({r["t"]: r["n"] for r in order.collect()})

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        place = lambda t: (often.get(t, 0), t)
        for batch in batches:
            words, chunks = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            # 32 bits a word are enough to compare two sets: of a hundred words two collide once in a million pairs
            columns = [
                pa.array([sorted({w >> 32 for w in x}) for x in words], pa.list_(pa.int32())),
                batch.column(4),
                pa.array([leading_chunks(sorted(x, key=place)) for x in chunks], _IDS),
                pa.array([leading_words(sorted(x, key=place)) for x in words], _IDS),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["rec", "batch_no", "cls", "words", "chunks", "lead_chunks", "lead_words"])

    return sets.select("rec", "batch_no", "cls", "words", "chunks").mapInArrow(
        lead, "rec bigint, batch_no int, cls binary, words array<int>, chunks array<bigint>, lead_chunks array<bigint>, lead_words array<bigint>"
    )


def _token(kind: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.unhex(F.md5(F.concat(F.lit(kind), value))))


def _norm(name: str) -> Column:
    return F.lower(present(F.col(name)))


class AcceptedHistory:
    """Persistent tables of what was accepted, bucketed by their join keys so that a batch shuffles itself alone.

    keys (k, rec): fingerprints and word-set names; postings (t, kind, rec, pos, n): chunks (kind 0) and rarest words (kind 1);
    sets (rec, words, chunks). They lie under ``path`` in the shared folder with the order of tokens they were made
    in, and ``open`` finds them again in any later session. Rows carry the run they were written by, and a run counts from
    its ``commit`` on: what a run that died has left behind is never read.
    """

    TABLES = {
        "keys": ("k binary, rec bigint, run bigint", "k"),
        "postings": ("t bigint, kind tinyint, rec bigint, pos int, n int, run bigint", "t"),
        "sets": ("rec bigint, words array<int>, chunks array<bigint>, run bigint", "rec"),
    }

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """``buckets`` are given for a history just made: there is nothing to read in it yet."""
        self.spark, self.root = spark, path
        self.name = f"accepted_{uuid.uuid4().hex[:10]}"
        order = spark.read.schema("t bigint, n bigint, buckets int").parquet(f"{path}/order")
        self.order, self.buckets, self.runs, self.spoilt = order.select("t", "n"), buckets, [], False
        if buckets is None:
            self.buckets = order.select("buckets").first()[0]
            self.runs = [r["run"] for r in spark.read.schema("run bigint").parquet(f"{path}/runs").collect()]
        for table, (columns, key) in self.TABLES.items():
            spark.sql(f"create table {self.name}_{table} ({columns}) using parquet clustered by ({key}) sorted by ({key}) into {self.buckets} buckets location '{self.path(table)}'")
            if buckets is None:
                self.spoilt |= not spark.table(f"{self.name}_{table}").where(~F.col("run").isin(self.runs)).isEmpty()

    @classmethod
    def create(cls, spark: SparkSession, path: str, order: DataFrame, buckets: int | None = None) -> AcceptedHistory:
        """An empty history under ``path``, for tokens in the given order (see ``common_order``)."""
        buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        marked = order.select("t", "n").unionByName(spark.createDataFrame([(None, None)], "t bigint, n bigint")).withColumn("buckets", F.lit(buckets))
        marked.write.parquet(f"{path}/order")
        spark.createDataFrame([], "run bigint").write.parquet(f"{path}/runs")
        return cls(spark, path, buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> AcceptedHistory:
        """The history that was left under ``path``."""
        return cls(spark, path)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def table(self, table: str) -> DataFrame:
        """Rows of all committed runs; looked at one by one only where others have left rows too."""
        rows = self.spark.table(f"{self.name}_{table}")
        return (rows.where(F.col("run").isin(self.runs)) if self.spoilt else rows).drop("run")

    def append(self, rows: DataFrame, table: str, run: int) -> None:
        columns, key = self.TABLES[table]
        writer = rows.withColumn("run", F.lit(run)).select(*(c.split()[0] for c in columns.split(", "))).repartition(self.buckets, key)
        writer.write.format("parquet").bucketBy(self.buckets, key).sortBy(key).mode("append").option("path", self.path(table)).saveAsTable(f"{self.name}_{table}")

    def commit(self, run: int) -> None:
        self.spark.range(1, numPartitions=1).select(F.lit(run).alias("run")).write.mode("append").parquet(f"{self.root}/runs")
        self.runs.append(run)

    def accepted(self) -> DataFrame:
        """rec of everything accepted so far."""
        return self.table("keys").select("rec").distinct()

    def close(self) -> None:
        """Forget the catalog's entries; the files stay."""
        for table in self.TABLES:
            self.spark.sql(f"drop table if exists {self.name}_{table}")


def prepare(scan: DataFrame, findings: DataFrame, scratch: Scratch, order: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables rows (rec, batch_no, cls, keys, known) of each finding and features (see ``with_leading``), and the order of tokens.

    ``known``: a fingerprint that the findings index had first seen before the batch. Fingerprints compare without
    letter case and outer blanks, missing ones equal nothing; an unreadable first_seen is before no batch. Repeated
    rows count once; were a finding_no to come with several contents, the greatest counts.

    The order of tokens must be one for all that is ever compared: a batch that comes later is prepared in the
    ``order`` of its history; without one that of ``scan`` itself is made.
    """
    read = scan.where("finding_no is not null").select(
        F.col("finding_no").cast("long").alias("rec"),
        F.coalesce("batch_no", F.lit(0)).cast("int").alias("batch_no"),
        F.col("batch_at").cast("timestamp_ntz").alias("at"),
        _token("s", _norm("semantic_fingerprint")).alias("s"),
        _token("f", _norm("fingerprint")).alias("f"),
        F.col("code_snippet").alias("snippet"),
    )
    both = scratch.keep(with_features(read), "features")
    sets = both.where("words is not null")
    order = order if order is not None else scratch.keep(common_order(sets), "order")
    features = scratch.keep(with_leading(sets, order.where("t is not null")), "leading")
    slim = both.groupBy("rec").agg(F.max(F.struct("batch_no", "at", "s", "f", "cls")).alias("v")).select("rec", "v.*")
    tokens = F.filter(F.array(_token("s", _norm("semantic_fingerprint")), _token("f", _norm("fingerprint"))), lambda t: t.isNotNull())
    first = findings.select(utc_time(F.col("first_seen")).alias("seen"), F.explode(tokens).alias("k")).where("seen is not null").groupBy("k").agg(F.min("seen").alias("seen"))
    keys = F.filter(F.array("s", "f"), lambda t: t.isNotNull())
    known = slim.select("rec", "at", F.explode(keys).alias("k")).join(first, "k").where("seen < at").select("rec").distinct().withColumn("known", F.lit(True))
    rows = slim.join(known, "rec", "left").select("rec", "batch_no", "cls", F.filter(F.array("s", "f", "cls"), lambda t: t.isNotNull()).alias("keys"), F.coalesce("known", F.lit(False)).alias("known"))
    return scratch.keep(rows, "rows"), features, order


def _postings(features: DataFrame, *kinds: int) -> DataFrame:
    """t, kind, rec, pos, n of the leading chunks (kind 0) and words (kind 1)."""
    columns = (("chunks", "lead_chunks"), ("words", "lead_words"))
    lists = F.array(*(F.struct(F.lit(kind).cast("tinyint").alias("kind"), F.size(columns[kind][0]).alias("n"), F.col(columns[kind][1]).alias("lead")) for kind in kinds))
    return features.select("rec", F.inline(lists)).select("rec", "kind", "n", F.posexplode("lead").alias("pos", "t")).select("t", "kind", "rec", "pos", "n")


def _members(rows: DataFrame) -> DataFrame:
    return rows.select("rec", F.explode("keys").alias("k"))


def _proposed(posted: DataFrame, others: DataFrame, *on: str) -> DataFrame:
    """rec, old: pairs with a leading token in common; on t alone where both sides have one kind, so that buckets by t serve.

    Of words a pair goes on where what is left of both sets from the shared word on is enough; of two sets that are alike
    this holds at the first word they share.
    """
    old = others.select(*on, F.col("rec").alias("old"), F.col("pos").alias("old_pos"), F.col("n").alias("old_n"))
    pairs = old.join(posted.hint("shuffle_hash"), [*on])
    enough = F.least(F.col("n") - F.col("pos"), F.col("old_n") - F.col("old_pos")) * (1 + MIN_SIMILARITY) >= MIN_SIMILARITY * (F.col("n") + F.col("old_n")) - 1e-6
    return pairs.where((F.col("kind") == 0) | enough).select("rec", "old")


def _posted(history: AcceptedHistory, kind: int) -> DataFrame:
    return history.table("postings").where(F.col("kind") == kind)


def _old(sets: DataFrame) -> DataFrame:
    return sets.select(F.col("rec").alias("old"), F.col("words").alias("old_words"), F.col("chunks").alias("old_chunks"))


def _alike() -> Column:
    shared = F.size(F.array_intersect("words", "old_words"))
    return shared / (F.size("words") + F.size("old_words") - shared) >= MIN_SIMILARITY


def _size(chunks: Column) -> Column:
    return F.aggregate(chunks, F.lit(0).cast("bigint"), lambda n, c: n + c.bitwiseAND(F.lit(0xFFFF)))


def covered(features: DataFrame, history: AcceptedHistory) -> DataFrame:
    """cls of the word sets like an accepted one that shares MIN_COVERAGE of the bytes in chunks with them."""
    pairs = _proposed(_postings(features, 0), _posted(history, 0), "t").distinct()
    both = _old(history.table("sets")).join(pairs.join(features.select("rec", "cls", "words", "chunks"), "rec").hint("shuffle_hash"), "old")
    shared = _size(F.array_intersect("chunks", "old_chunks"))
    return both.where(shared >= MIN_COVERAGE * F.greatest(_size(F.col("chunks")), _size(F.col("old_chunks"))) - 1e-6).where(_alike()).select("cls").distinct()


def uncovered_like(features: DataFrame, history: AcceptedHistory) -> DataFrame:
    """cls of the word sets like an accepted one, by their rarest words: what coverage has left undecided."""
    pairs = _proposed(_postings(features, 1), _posted(history, 1), "t").distinct()
    return _old(history.table("sets")).join(pairs.join(features.select("rec", "cls", "words"), "rec").hint("shuffle_hash"), "old").where(_alike()).select("cls").distinct()


def like_pairs(features: DataFrame) -> DataFrame:
    """k, other: names of word sets of one run that are alike, by common chunks and rarest words."""
    posted = _postings(features, 0, 1)
    pairs = _proposed(posted, posted, "t", "kind").where("old < rec").distinct()
    both = pairs.join(features.select("rec", F.col("cls").alias("k"), "words"), "rec").join(_old(features).join(features.select(F.col("rec").alias("old"), F.col("cls").alias("other")), "old"), "old")
    return both.where("k <> other").where(_alike()).select("k", "other")


def _repeats_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rec of the repeats among rows (k, rec, null), the keys of records, and (k, null, other), the like pairs."""
    keys, near = defaultdict(list), defaultdict(list)
    for batch in batches:
        for k, rec, other in zip(*(c.to_pylist() for c in batch.columns)):
            if other is None:
                keys[rec].append(k)
            else:
                near[k].append(other)
                near[other].append(k)
    taken, repeats = set(), []
    for rec in sorted(keys):
        if taken.isdisjoint(keys[rec]):
            taken.update(keys[rec], *(near[k] for k in keys[rec] if k in near))
        else:
            repeats.append(rec)
    yield pa.RecordBatch.from_arrays([pa.array(repeats, pa.int64())], names=["rec"])


def _settled_round(left: DataFrame, both: DataFrame) -> DataFrame:
    """rec, repeat: what one round decides. A row with no undecided earlier row like it is accepted, all later ones like it are repeats."""
    least = left.groupBy("k").agg(F.min("rec").alias("lo"))
    linked = both.join(least.withColumnRenamed("k", "other"), "other").groupBy("k").agg(F.min("lo").alias("lo2"))
    leader = left.join(least, "k").join(linked, "k", "left").groupBy("rec").agg(F.min(F.least("lo", F.coalesce("lo2", "lo"))).alias("lo")).where("lo = rec").select("rec")
    by = left.join(leader, "rec", "left_semi").groupBy("k").agg(F.min("rec").alias("by"))
    near = both.join(by.withColumnRenamed("k", "other"), "other").groupBy("k").agg(F.min("by").alias("by2"))
    verdict = left.join(by, "k", "left").join(near, "k", "left").groupBy("rec").agg(F.min(F.least("by", "by2")).alias("by"))
    return verdict.where("by is not null").select("rec", (F.col("by") < F.col("rec")).alias("repeat"))


def settled_repeats(left: DataFrame, pairs: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Tables of rec: the repeats among the undecided rows left (k, rec), of which those named in pairs (k, other) are alike.

    Many are settled in rounds, each some jobs of the driver, until SETTLE_ROWS are left, which one task takes in order.
    """
    both = pairs.select("k", "other").unionByName(pairs.select(F.col("other").alias("k"), F.col("k").alias("other")))
    repeats, n_pairs = [], None
    while n := left.count():
        n_pairs = pairs.count() if n_pairs is None else n_pairs
        if n + n_pairs <= SETTLE_ROWS:
            rows = left.select("k", "rec", F.lit(None).cast("binary").alias("other")).unionByName(pairs.select("k", F.lit(None).cast("bigint").alias("rec"), "other"))
            return [*repeats, scratch.keep(rows.coalesce(1).mapInArrow(_repeats_in_order, "rec bigint"), "settled")]
        settled = scratch.keep(_settled_round(left, both), "settled")
        repeats.append(settled.where("repeat").select("rec"))
        left = left.join(settled, "rec", "left_anti")
    return repeats


def judge_run(rows: DataFrame, features: DataFrame, first: int, last: int, history: AcceptedHistory, scratch: Scratch) -> None:
    """Append to the history what is accepted of the batches first to last, which come after everything in the history.

    Rows are taken in order of rec. A row is a repeat when a key or a word set like its own was accepted before, in the
    history or earlier in the run. What the history has is taken off step by step, so that each step looks up less: equal
    keys, then chunks by coverage, then rarest words; an empty history isn't asked. Rows whose answer hangs on earlier rows
    of the run are settled among themselves (``settled_repeats``). Equal keys and equal word sets act as groups, never as pairs.
    """
    in_run = F.col("batch_no").between(first, last)
    alive = rows.where(in_run & ~F.col("known")).select("rec", "cls", "keys")
    if history.runs:
        alive = alive.join(history.table("keys").select("k").join(_members(alive).hint("shuffle_hash"), "k").select("rec").distinct(), "rec", "left_anti")
    alive = scratch.keep(alive, "alive")
    named = features.where(in_run).join(alive.where("cls is not null").select("cls").distinct(), "cls", "left_semi")
    rest = [c for c in features.columns if c not in ("cls", "rec")]
    mine = scratch.keep(named.groupBy("cls").agg(F.min("rec").alias("rec"), F.min_by(F.struct(*rest), "rec").alias("v")).select("cls", "rec", "v.*"), "mine")
    if history.runs:
        like = scratch.keep(covered(mine, history), "covered")
        mine = mine.join(like, "cls", "left_anti")
        like = like.unionByName(scratch.keep(uncovered_like(mine, history), "like"))
        mine = scratch.keep(mine.join(like, "cls", "left_anti"), "new")
        alive = alive.join(like, "cls", "left_anti")
    pairs = scratch.keep(like_pairs(mine), "pairs")
    members = _members(alive)
    in_pairs = pairs.select(F.explode(F.array("k", "other")).alias("k"))
    crowded = members.select("k", F.lit(1).alias("n")).unionByName(in_pairs.withColumn("n", F.lit(2))).groupBy("k").agg(F.sum("n").alias("n")).where("n > 1").select("k")
    left = scratch.keep(members.join(crowded, "k", "left_semi"), "contested")
    accepted = scratch.keep(reduce(lambda rest, gone: rest.join(gone, "rec", "left_anti"), settled_repeats(left, pairs, scratch), alive), "accepted")
    run = uuid.uuid4().int >> 65
    # a record without any key is kept too, under a key of its own
    named = accepted.withColumn("keys", F.when(F.size("keys") == 0, F.array(_token("r", F.col("rec").cast("string")))).otherwise(F.col("keys")))
    kept = mine.join(accepted.where("cls is not null").select("cls").distinct(), "cls", "left_semi")
    parts = {"keys": _members(named), "postings": _postings(kept, 0, 1), "sets": kept.select("rec", "words", "chunks")}
    history.spoilt, clean = True, not history.spoilt
    for table, added in parts.items():  # one after the other: side by side the driver holds three plans and their stages at once
        history.append(added, table, run)
    history.commit(run)
    history.spoilt = not clean


def runs_of(rows: DataFrame) -> list[tuple[int, int]]:
    """(first batch, last batch) of the runs to judge, in order.

    A batch is a run, and the newest always one of its own; batches of few rows before it go together up to RUN_ROWS rows, as
    long as their records rise from batch to batch.
    """
    runs: list[tuple[int, int]] = []
    size, top = math.inf, None
    batches = rows.groupBy("batch_no").agg(F.min("rec").alias("a"), F.max("rec").alias("b"), F.count("*").alias("n")).orderBy("batch_no").collect()
    for r in batches:
        if size + r["n"] <= RUN_ROWS and r["a"] > top and r is not batches[-1]:
            runs[-1], size = (runs[-1][0], r["batch_no"]), size + r["n"]
        else:
            runs, size = [*runs, (r["batch_no"], r["batch_no"])], r["n"]
        top = r["b"]
    return runs


def repeated_findings(scan: DataFrame, findings: DataFrame, path: str | None = None) -> DataFrame:
    """finding_no of each row of the batches that repeats something known or accepted before it.

    Runs of batches are judged one after the other, each against the history. With ``path`` the history stays there for the
    batches to come (``AcceptedHistory.open`` and ``judge_run``), else it is scratch. A null batch number counts as 0.
    Empty tables give no rows. The driver sees the numbers of the batches and no row of them.
    """
    spark = scan.sparkSession
    scratch = Scratch(spark, "batches")
    rows, features, order = prepare(scan, findings, scratch)
    history = AcceptedHistory.create(spark, path or scratch.path("history"), order)
    for first, last in runs_of(rows):
        judge_run(rows, features, first, last, history, scratch)
    columns, _ = AcceptedHistory.TABLES["keys"]
    written = spark.read.schema(columns).parquet(history.path("keys")) if history.runs else history.table("keys")
    out = rows.select(F.col("rec").alias("finding_no")).join(written.select(F.col("rec").alias("finding_no")), "finding_no", "left_anti")
    history.close()
    return out

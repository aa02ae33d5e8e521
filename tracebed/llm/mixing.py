"""Mixing sources to target shares of the total size, by systematic sampling with capped repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracebed.llm.tokens import encode_texts
from tracebed.session import Scratch

#: documents of one stratum block; prefix sums run inside a block and over blocks
BLOCK = 20_000


def source_name(col: Column) -> Column:
    """One spelling of a source: outer blanks, letter case and hyphens against underscores don't count."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(col)), "[- ]", "_"), F.lit(""))


def sized_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens; whole rows repeated count once, null and empty texts have 0 tokens."""
    once = docs.select("doc_id", "text", source_name(F.col("source")).alias("source")).where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("source", "text")).alias("v"))
    flat = once.select(F.struct("doc_id", "v.source").alias("key"), F.col("v.text").alias("text"))
    # the encoder carries one id column: source rides along inside it
    ids = encode_texts(flat.select(F.to_json("key").alias("doc_id"), "text"), vocabulary=vocabulary)
    key = F.from_json("doc_id", "doc_id bigint, source string")
    return ids.select(key["doc_id"].alias("doc_id"), key["source"].alias("source"), F.size("ids").cast("long").alias("n_tokens"))


def copy_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, goal (tokens in the mixture), rate (goal / own_tokens: expected copies of each document), target_share, own_tokens, total.

    Targets are weighed against each other (they need not sum to 1). The mixture is as large as the target sources
    are together; where a source's cap keeps it under its share, what is missing goes to the other sources in
    proportion to their targets, again and again until none is over its cap: a level L is sought with
    sum(min(cap, share * L)) = total. One row per source, so the windows here hold a handful of rows however large the corpus.
    """
    wanted = (
        targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").alias("w"), F.col("max_repeats").alias("r"))
        .where("source is not null and w > 0 and r > 0")
        .groupBy("source")
        .agg(F.max("w").alias("w"), F.max("r").alias("r"))
    )
    own = sizes.groupBy("source").agg(F.sum("n_tokens").alias("own_tokens"))
    both = wanted.join(own, "source").where("own_tokens > 0")
    everything = Window.partitionBy()
    s = both.withColumn("total", F.sum("own_tokens").over(everything)).withColumn("share", F.col("w") / F.sum("w").over(everything))
    s = s.withColumn("cap", F.col("own_tokens") * F.col("r")).withColumn("full_at", F.col("cap") / F.col("share"))
    # sources fill up in order of full_at; while the first m are full, the level is (total - their caps) / rest of the shares
    filled = Window.partitionBy().orderBy("full_at", "source").rowsBetween(Window.unboundedPreceding, -1)
    caps = F.coalesce(F.sum("cap").over(filled), F.lit(0))
    shares = F.coalesce(F.sum("share").over(filled), F.lit(0.0))
    s = s.withColumn("level", (F.col("total") - caps) / F.greatest(1 - shares, F.col("share")))
    # the level is that of the first source which doesn't fill up at its own level; none: all are full
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source", "level"))).over(everything)["level"])
    size = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap").cast("double"), F.col("share") * F.col("level")))
    s = s.withColumn("goal", F.round(size).cast("bigint"))
    return s.select("source", "goal", (F.col("goal") / F.col("own_tokens")).alias("rate"), F.col("share").alias("target_share"), F.col("r").alias("max_repeats"), "own_tokens", "total")


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens, copy_no (from 1): the documents of the mixture, one row for each copy.

    Within a source, documents are ordered by size class and then by a seeded hash, so that every stretch of the
    order holds sizes in proportion; the running sum of expected copies starts at a random offset in [0, 1) and a
    copy is emitted for each whole number it crosses. No document occurs more than max_repeats times, because its
    rate is at most that and whole numbers are one apart. Sources without a target, and documents without source, are
    not mixed in; empty texts have copies of size 0. Sums run in blocks, so a source with a third of all rows is as
    parallel as any other.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.keep(sized_documents(docs, vocabulary), "sizes")
    return _copies(sized, scratch.keep(copy_rates(sized, targets), "rates"), seed, scratch)


def _copies(sized: DataFrame, rates: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    h = F.xxhash64(F.lit(seed), "doc_id")
    keyed = sized.withColumn("class", F.floor(4 * F.log2(F.col("n_tokens") + 1)).cast("int")).withColumn("h", h)
    strata = keyed.groupBy("source", "class").agg(F.count("*").alias("n")).select("source", "class", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = keyed.join(rates.select("source", "goal", "own_tokens"), "source").join(strata, ["source", "class"])
    unit = (F.shiftrightunsigned(F.col("h"), 11)) / F.lit(float(1 << 53))
    rows = rows.withColumn("block", F.floor(unit * F.col("blocks")).cast("int")).select("doc_id", "source", "n_tokens", "goal", "own_tokens", "class", "block", "h")
    rows = scratch.keep(rows, "blocks")
    order = Window.partitionBy("source").orderBy("class", "block")
    starts = (
        rows.groupBy("source", "class", "block")
        .agg(F.count("*").alias("n"))
        .select("source", "class", "block", (F.sum("n").over(order) - F.col("n")).alias("before"))
    )
    within = F.row_number().over(Window.partitionBy("source", "class", "block").orderBy("h", "doc_id"))
    placed = rows.withColumn("k", within).join(starts, ["source", "class", "block"]).withColumn("k", F.col("k") + F.col("before"))
    # the running sum of expected copies is goal * k / own_tokens, kept as a fraction: whole numbers, exact at any size
    offset = F.floor(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("offset"), "source"), 11) / F.lit(float(1 << 53)) * F.col("own_tokens"))
    placed = placed.withColumn("offset", offset)
    upto = lambda k: F.expr(f"(cast(goal as decimal(19, 0)) * cast({k} as decimal(18, 0)) + offset) div own_tokens")
    copies = upto("k") - upto("(k - 1)")
    return placed.select("doc_id", "source", "n_tokens", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))).otherwise(F.array().cast("array<int>"))).alias("copy_no"))


def mixture_shares(docs: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str | None = None) -> DataFrame:
    """One row for each mixed source: target_share, actual_share, n_copies, n_docs, tokens, own_tokens, rate, max_copies."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.keep(sized_documents(docs, vocabulary), "sizes")
    rates = scratch.keep(copy_rates(sized, targets), "rates")
    mixed = scratch.keep(_copies(sized, rates, seed, scratch), "mixture")
    got = mixed.groupBy("source").agg(
        F.count("*").alias("n_copies"), F.sum((F.col("copy_no") == 1).cast("long")).alias("n_docs"), F.sum("n_tokens").alias("tokens"), F.max("copy_no").alias("max_copies")
    )
    out = rates.join(got, "source", "left").fillna(0, ["n_copies", "n_docs", "tokens", "max_copies"])
    share = F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 6)
    return out.select("source", F.round("target_share", 6).alias("target_share"), share.alias("actual_share"), "n_copies", "n_docs", "tokens", "own_tokens", F.round("rate", 6).alias("rate"), "max_copies")

"""Column helpers for dirty text: blanks, missing values, uneven timestamps and uneven paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_free(col: Column) -> Column:
    """Outer blanks removed; null becomes the empty string (both mean missing)."""
    return F.coalesce(F.trim(col), F.lit(""))


def present(col: Column) -> Column:
    """Outer blanks removed; empty becomes null."""
    return F.nullif(F.trim(col), F.lit(""))


def utc_time(col: Column) -> Column:
    """A UTC time written with a blank or a T, with or without fraction and Z; null where it can't be read."""
    return F.regexp_replace(F.trim(col), "Z$", "").try_cast("timestamp_ntz")


def plain_path(col: Column) -> Column:
    """One spelling for each file: forward slashes, single, no ``.`` step, ``..`` resolved, outer blanks gone.

    A ``..`` with nothing before it stays in a relative path and is dropped at the root of an absolute one.
    Null and blank give null.
    """
    slashed = F.regexp_replace(F.trim(col), r"\\", "/")
    absolute = slashed.startswith("/")
    steps = F.filter(F.split(slashed, "/"), lambda s: (s != "") & (s != "."))

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        return (
            F.when(s != "..", F.concat(done, F.array(s)))
            .when(F.size(done).__eq__(0), F.when(absolute, done).otherwise(F.array(s)))
            .when(last == "..", F.concat(done, F.array(s)))
            .otherwise(F.slice(done, F.lit(1), F.size(done) - 1))
        )

    resolved = F.aggregate(steps, F.array().cast("array<string>"), step)
    # most paths need no folding, and the fold is interpreted: only odd ones take it
    odd = slashed.rlike(r"(^|/)\.{0,2}(/|$)")
    folded = F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(resolved, "/"))
    return F.nullif(F.when(odd, folded).otherwise(slashed), F.lit(""))

"""Package versions against advisories with version ranges, and whether the packages are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def version_numbers(version: Column) -> Column:
    """The first six numbers of a version before any + or -, as an array that compares in order."""
    plain = F.regexp_extract(F.coalesce(version, F.lit("")), r"^[^+-]*", 0)
    return F.slice(F.transform(F.regexp_extract_all(plain, F.lit(r"[0-9]+"), F.lit(0)), lambda x: x.try_cast("bigint")), 1, 6)


def affected_packages(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Packages (ecosystem, package, version) joined with the advisories that hit them.

    An advisory (id, ecosystem, package, introduced, fixed, versions) hits a version it lists, or one from introduced on and
    before fixed; with neither bound and no list it hits nothing. The equi join is on names in small letters, the range a
    residual on number arrays, so the join stays a hash or sort-merge join.
    """
    key = lambda c: F.lower(F.trim(c))
    p = packages.withColumn("e", key("ecosystem")).withColumn("p", key("package")).withColumn("v", version_numbers(F.col("version")))
    a = advisories.select(F.col("id").alias("advisory"), key("ecosystem").alias("e"), key("package").alias("p"), "introduced", "fixed", "versions", version_numbers(F.col("introduced")).alias("from"), version_numbers(F.col("fixed")).alias("to"))
    listed = F.coalesce(F.array_contains("versions", F.col("version")), F.lit(False))
    bounded = (F.col("introduced").isNotNull() | F.col("fixed").isNotNull()) & (F.col("introduced").isNull() | (F.col("from") <= F.col("v"))) & (F.col("fixed").isNull() | (F.col("v") < F.col("to")))
    return p.join(a, ["e", "p"]).where(listed | bounded).drop("e", "p", "v", "from", "to", "versions")

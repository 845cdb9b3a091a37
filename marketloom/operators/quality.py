"""Data-quality jobs: each returns rows of findings, never an exception."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_parents(checks: list[tuple[str, DataFrame, DataFrame, str]]) -> DataFrame:
    """(check, key): keys of the first table that the second lacks."""
    out = None
    for name, child, parent, key in checks:
        part = child.select(key).distinct().join(parent.select(key), key, "left_anti").select(F.lit(name).alias("check"), F.col(key).cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def field_checks(df: DataFrame, enums: dict[str, list[str]], required: list[str], dates: list[str]) -> DataFrame:
    """(check, field, n): unknown values, nulls or blanks, and texts that are no date."""
    rules = [("unknown", c, ~F.col(c).isin(*v)) for c, v in enums.items()]
    rules += [("blank", c, F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")) for c in required]
    rules += [("bad date", c, F.col(c).isNotNull() & F.try_to_date(F.col(c).cast("string"), "yyyy-MM-dd").isNull()) for c in dates]
    one = df.agg(*(F.count_if(cond).alias(f"c{i}") for i, (_, _, cond) in enumerate(rules)))
    rows = F.array(*(F.struct(F.lit(k).alias("check"), F.lit(c).alias("field"), F.col(f"c{i}").alias("n")) for i, (k, c, _) in enumerate(rules)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def against_expectation(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Counts by key against expected counts: OK, MISMATCH, UNSUPPORTED (unexpected key) or MISSING."""
    j = actual.withColumnRenamed("n", "actual").join(expected.withColumnRenamed("n", "expected"), key, "full_outer")
    state = F.when(F.col("expected").isNull(), "UNSUPPORTED").when(F.col("actual").isNull(), "MISSING").when(F.col("actual") == F.col("expected"), "OK").otherwise("MISMATCH")
    return j.select(key, F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce("expected", F.lit(0)).alias("expected"), state.alias("state"))

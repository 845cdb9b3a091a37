"""Tables that are merged by key: Parquet in hash buckets, of which a merge rewrites those whose rows change and no other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .tables import overwrite, scratch

BUCKET = "_bucket"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder through the file system that its path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _bucketed(like: DataFrame) -> StructType:
    return StructType([*like.schema.fields, StructField(BUCKET, IntegerType())])


def create(df: DataFrame, path: str, keys: list[str], buckets: int = 32) -> DataFrame:
    """Writes df as a table of so many buckets by its keys (null keys count as keys)."""
    df.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(buckets, BUCKET).write.partitionBy(BUCKET).parquet(path)
    return read(df.sparkSession, path, df)


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(_bucketed(like)).parquet(path).drop(BUCKET)


def _digest(df: DataFrame) -> DataFrame:
    """Rows and their hash sum by bucket; equal tables have equal digests in whatever order."""
    return df.groupBy(BUCKET).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*(c for c in df.columns if c != BUCKET)).cast("decimal(38,0)")).alias("h"))


def merge_into(path: str, batch: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], like: DataFrame, buckets: int = 32) -> int:
    """Merges batch into the table and returns the number of buckets that were rewritten.

    merge(stored, batch) gives the new rows of the stored ones, with the columns of like; it sees the buckets that the keys
    of batch fall in, whole, and must treat keys apart. Buckets that come out as they were are left alone, so a batch that is
    merged again changes no file. The new buckets are written aside and then put in place by one dynamic overwrite; if that is cut off,
    merging the batch again ends it."""
    spark, columns = batch.sparkSession, like.columns
    touched = sorted(r[0] for r in batch.select(bucket_of(keys, buckets)).distinct().collect())  # at most as many as buckets
    if not touched:
        return 0
    stored = spark.read.schema(_bucketed(like)).parquet(path).where(F.col(BUCKET).isin(touched))
    merged = merge(stored.select(*columns), batch).select(*columns).withColumn(BUCKET, bucket_of(keys, buckets))
    new = overwrite(merged.repartition(len(touched), BUCKET), scratch(spark, "merged"))
    old = _digest(stored).select(BUCKET, F.col("n").alias("old_n"), F.col("h").alias("old_h"))
    both = _digest(new).join(old, BUCKET, "left")
    changed = [r[0] for r in both.where("not (n <=> old_n and h <=> old_h)").select(BUCKET).collect()]
    if changed:
        out = new.where(F.col(BUCKET).isin(changed)).repartition(len(changed), BUCKET)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return len(changed)

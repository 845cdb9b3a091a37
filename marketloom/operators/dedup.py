"""De-duplication, upsert and persistence semantics on keys, set-based and idempotent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import overwrite, scratch


def null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def insert_if_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows that are new on a null-safe key, repeats within the batch once."""
    fresh = incoming.dropDuplicates(keys)
    return fresh.join(stored, null_safe(fresh, stored, keys), "left_anti")


def coalesced_key(df: DataFrame, *columns: str) -> Column:
    """The first non-blank column, tagged with its place so different columns never meet."""
    return F.coalesce(*(F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{i}:"), F.lower(F.trim(F.col(c).cast("string"))))) for i, c in enumerate(columns)))


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by order, with all columns, by partial aggregation."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in df.columns if c not in keys)), order).alias("_r")).select(*keys, "_r.*")


def merge_categories(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row per key: sorted distinct categories and the first non-blank model."""
    filled = F.when(F.col("model") != "", F.col("model"))
    return df.withColumn("key", key).groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.min_by(filled, F.when(filled.isNotNull(), F.col(order))).alias("model"),
    )


def merge_offers(df: DataFrame, order: str) -> DataFrame:
    """One row per sku, else url, else name: prices of the first row in order that has a sale price, regular and sale
    together (else the first regular price), whether any row is on sale, and the first sku."""
    key = F.coalesce(F.concat(F.lit("sku:"), "sku"), F.concat(F.lit("url:"), "url"), F.concat(F.lit("name:"), "product_name"))
    on_sale = F.when(F.col("sale_price").isNotNull(), F.col(order))
    offer = F.min_by(F.struct("regular_price", "sale_price"), on_sale).alias("offer")
    plain = F.min_by("regular_price", order).alias("plain")
    sku = F.min_by("sku", F.when(F.col("sku").isNotNull(), F.col(order))).alias("sku")
    g = df.withColumn("key", key).groupBy("key").agg(offer, plain, F.bool_or("is_sale").alias("is_sale"), sku)
    return g.select("key", F.coalesce("offer.regular_price", "plain").alias("regular_price"), "offer.sale_price", "is_sale", "sku")


def upsert_seen(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """First and last seen dates after a batch: a union and one aggregation, the same for any batch order."""
    both = stored.select(*keys, "first_seen_date", "last_seen_date").unionByName(
        incoming.select(*keys, F.col("observed_date").alias("first_seen_date"), F.col("observed_date").alias("last_seen_date"))
    )
    return both.groupBy(*keys).agg(F.min("first_seen_date").alias("first_seen_date"), F.max("last_seen_date").alias("last_seen_date"))


def get_or_create(stored: DataFrame, incoming: DataFrame, keys: list[str], id_column: str, values: list[str]) -> DataFrame:
    """Stored rows keep their ids and take new values; new keys get dense ids after the largest stored one."""
    new = incoming.dropDuplicates(keys)
    j = stored.select(F.col(id_column), *(F.col(k) for k in keys), *(F.col(v).alias(f"old_{v}") for v in values)).alias("s")
    hit = new.alias("n").join(j, reduce(lambda x, y: x & y, [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]), "full_outer")
    pick = lambda k: F.coalesce(F.col(f"n.{k}"), F.col(f"s.{k}")).alias(k)
    rows = hit.select(F.col(f"s.{id_column}").alias("old_id"), *map(pick, keys), *(F.coalesce(F.col(f"n.{v}"), F.col(f"s.old_{v}")).alias(v) for v in values))
    # A new id is the stored maximum plus a dense number.
    last = stored.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("last_id"))
    fresh = dense_rank_rows(rows.where("old_id is null"), keys, "offset").crossJoin(F.broadcast(last))
    made = fresh.withColumn(id_column, F.col("last_id") + F.col("offset")).select(id_column, *keys, *values)
    return rows.where("old_id is not null").select(F.col("old_id").alias(id_column), *keys, *values).unionByName(made)


def dense_rank_rows(df: DataFrame, keys: list[str], name: str, buckets: int | None = None) -> DataFrame:
    """Adds name: 1, 2, 3, ... one by one, in an order that the keys fix, without a single-partition sort.

    Rows are numbered within buckets of the keys' hash (by default 16 for each shuffle partition), and buckets start
    after each other."""
    buckets = buckets or 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucketed = df.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    local = bucketed.withColumn("_n", F.row_number().over(W.partitionBy("_b").orderBy(*keys)))
    sizes = bucketed.groupBy("_b").agg(F.count("*").alias("_size"))
    starts = sizes.withColumn("_start", F.sum("_size").over(W.orderBy("_b")) - F.col("_size")).drop("_size")
    return local.join(F.broadcast(starts), "_b").withColumn(name, F.col("_start") + F.col("_n")).drop("_b", "_n", "_start")


#: Rows that one task numbers, on average at most.
ROWS_A_TASK = 1_000_000


def number_in_order(df: DataFrame, group: str, order: list[str], name: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """Adds name: 1, 2, 3, ... in each group by order, as row_number would, however large a group is.

    Rows are cut into ranges of group and all order columns, as many as their number asks for, and written with the number of
    their range; they are numbered in it and start after those of the group's ranges before. Equal first columns are split by the later
    ones; only rows that are equal in all of them stay together."""
    n = max(1, -(-df.count() // rows))
    ranged = df.repartitionByRange(n, group, *order).withColumn("_b", F.spark_partition_id())
    placed = overwrite(ranged, scratch(df.sparkSession, "ranges"))
    local = placed.withColumn("_n", F.row_number().over(W.partitionBy(group, "_b").orderBy(*order)))
    sizes = placed.groupBy(group, "_b").agg(F.count("*").alias("_size"))
    starts = sizes.withColumn("_start", F.sum("_size").over(W.partitionBy(group).orderBy("_b")) - F.col("_size")).drop("_size")
    own = reduce(lambda x, y: x & y, [F.col(f"l.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (group, "_b")])
    joined = local.alias("l").join(starts.alias("s"), own)
    return joined.select(*(F.col(f"l.{c}") for c in df.columns), (F.col("s._start") + F.col("l._n")).alias(name))


def evidence_key(url: Column, headline: Column) -> Column:
    """What tells records apart: the canonical url, where there is none the hash of the normalised headline."""
    named = F.trim(F.coalesce(url, F.lit("")))
    return F.when(named != "", T.canonical_url(named)).otherwise(F.sha1(F.lower(T.squeeze(F.coalesce(headline, F.lit("")))).cast("binary")))


def longest_per_key(df: DataFrame, keys: list[Column], text: str, tie: str) -> DataFrame:
    """The row with the longest text of each key; the smallest tie column decides."""
    named = df.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    best = F.max_by(F.struct(*(F.col(c) for c in df.columns)), F.struct(F.length(F.coalesce(F.col(text), F.lit(""))), -F.col(tie))).alias("r")
    return named.groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(best).select("r.*")


def update_by_key(df: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values where updates has the key, old ones elsewhere."""
    u = updates.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    j = df.join(u, key, "left")
    return j.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns))

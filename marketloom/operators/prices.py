"""Price history operators: movements, ambiguity, as-of lookups, engagement history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import overwrite, scratch
from .intervals import interval_join, merge_runs

IDENTITY = ["competitor_id", "id_brand", "id_model", "id_product"]


def with_identity(prices: DataFrame) -> DataFrame:
    """Adds the upper-cased identity columns; rows with a blank part or without a price are dropped."""
    named = prices.withColumns({"id_brand": T.identity_text(F.col("brand")), "id_model": T.identity_text(F.col("model")), "id_product": T.identity_text(F.col("product_name"))})
    return named.where("competitor_id is not null and id_brand <> '' and id_model <> '' and id_product <> '' and price_kes is not null and observed_date is not null")


def latest_per_day(prices: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per identity and day: that of the highest observation id (then the highest price), by partial aggregation.
    carry: further columns of that row."""
    kept = ["observation_id", "price_kes", *carry]
    row = F.max(F.struct(*kept)).alias("row")
    days = with_identity(prices).groupBy(*IDENTITY, "observed_date").agg(row, F.count("*").alias("n_rows"))
    return days.select(*IDENTITY, "observed_date", *(f"row.{c}" for c in kept), "n_rows")


def detect_movements(prices: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive days of an identity whose prices differ, with change and percent, and columns of the later row."""
    w = W.partitionBy(*IDENTITY).orderBy("observed_date")
    days = latest_per_day(prices, carry).withColumns({"previous_price": F.lag("price_kes").over(w), "previous_date": F.lag("observed_date").over(w)})
    moved = days.where("previous_price is not null and previous_price <> price_kes")
    return moved.select(
        *IDENTITY, "previous_date", "observed_date", "previous_price", F.col("price_kes").alias("current_price"),
        T.half_up(F.col("price_kes") - F.col("previous_price")).alias("change"),
        T.pct_change(F.col("previous_price"), F.col("price_kes")).alias("pct"), *carry,
    )


def movement_counts(movements: DataFrame, dimensions: dict[str, str], least: dict[str, int]) -> DataFrame:
    """(dimension, value, movements, rises, falls) for each dimension's column; some dimensions list values of least movements."""
    rows = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value")) for d, c in dimensions.items()))
    one = movements.select(F.explode(rows).alias("r"), "change").select("r.*", "change")
    g = one.groupBy("dimension", "value").agg(F.count("*").alias("movements"), F.count_if(F.col("change") > 0).alias("rises"), F.count_if(F.col("change") < 0).alias("falls"))
    return g.where(F.col("movements") >= T.first_rule([(F.col("dimension") == d, n) for d, n in least.items()], 1))


def ambiguous_identities(prices: DataFrame) -> DataFrame:
    """Identities with more than one row on some day."""
    return latest_per_day(prices).where("n_rows > 1").groupBy(*IDENTITY).agg(F.count("*").alias("ambiguous_days"))


def previous_price(prices: DataFrame, keys: list[str]) -> DataFrame:
    """The price of the latest earlier day with the same keys, for every observation; the highest id breaks a tie.

    Days are aggregated first, so the window runs over one row per key and day."""
    days = prices.groupBy(*keys, "observed_date").agg(F.max(F.struct("observation_id", "price_kes")).alias("r"))
    w = W.partitionBy(*keys).orderBy("observed_date")
    before = days.select(*keys, "observed_date", F.lag("r.price_kes").over(w).alias("previous_price"))
    return prices.join(before, [*keys, "observed_date"], "left")


def engagement_growth(social: DataFrame) -> DataFrame:
    """One snapshot per post and day (highest id), with growth in likes since the post's last snapshot."""
    days = social.groupBy("post_url", "observed_date").agg(F.max_by(F.struct("likes", "views"), "observation_id").alias("r"))
    w = W.partitionBy("post_url").orderBy("observed_date")
    out = days.select("post_url", "observed_date", "r.likes", "r.views")
    return out.withColumn("likes_growth", F.col("likes") - F.lag("likes").over(w))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def movement_dates(movements: DataFrame) -> DataFrame:
    """Two rows for each movement: `on` is its observed date (later true) or its previous date."""
    roles = F.array(F.struct(F.lit(True).alias("later"), F.col("observed_date").alias("on")), F.struct(F.lit(False).alias("later"), F.col("previous_date").alias("on")))
    return movements.withColumn("_r", F.explode(roles)).select(*movements.columns, "_r.later", "_r.on")


def overlapping_campaigns(movements: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Movement and campaign pairs, whoever runs the campaign, where either movement date lies in the campaign interval.

    Movements are written once; their dates meet the intervals by an exact equi-join. A pair that meets on both dates comes
    from the later one alone, so pairs need no distinct; a campaign without any date meets nothing.
    """
    stored = overwrite(movements, scratch(movements.sparkSession, "movements"))
    keep = ["campaign_id", "campaign_competitor", *(c for c in ["campaign_name"] if c in campaigns.columns), "start_date", "end_date"]
    c = campaigns.withColumnRenamed("competitor_id", "campaign_competitor").select(*keep)
    later_too = F.coalesce(F.col("observed_date") >= F.col("start_date"), F.lit(True)) & F.coalesce(F.col("observed_date") <= F.col("end_date"), F.lit(True))
    return interval_join(movement_dates(stored), "on", c, "start_date", "end_date").where(F.col("later") | ~later_too).drop("later", "on")


def concurrent_runs(movements: DataFrame, campaigns: DataFrame, keys: list[str]) -> DataFrame:
    """(previous_date, observed_date, keys) once where either date lies in an interval of campaigns with these keys.

    The intervals of a key are merged into disjoint runs, and movements enter as distinct pairs of dates, of which there
    are no more than the calendar has: no table of movement and campaign pairs is built."""
    dates = overwrite(movements.select("previous_date", "observed_date").distinct(), scratch(movements.sparkSession, "movement-dates"))
    runs = merge_runs(campaigns, keys, "start_date", "end_date")
    met = interval_join(movement_dates(dates), "on", runs, "start_date", "end_date")
    return met.select("previous_date", "observed_date", *keys).distinct()

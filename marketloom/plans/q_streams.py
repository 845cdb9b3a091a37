"""Queries that run the streaming jobs over the test tables to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prices as P
from ..sources.tables import overwrite, scratch
from ..streaming import jobs as Z
from .registry import query


def events(t, label):
    """The events as a stream of four micro-batches in order of time."""
    e = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    path, files = Z.deal_by_time(e, "ts", scratch(t.spark, f"{label}-events"))
    e = t.spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(path)
    return e.select(F.col("event_id").alias("observation_id"), "user_id", "event_type", "ts",
        F.expr("'https://social.example.com/' || (event_id % 5000)").alias("post_url"), F.get_json_object("props", "$.k").cast("long").alias("likes"))


@query("z1", "select user_id, event_type, cast(ts as date) as day, count(*) > 0 as seen from events group by 1, 2, 3")
def z1(t):
    days = Z.once_per_day(events(t, "z1"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "day", F.lit(True).alias("seen"))
    return Z.run_to_end(days, "append", "z1")


@query("z2", "select user_id, min(cast(ts as date)) as first_seen_date, max(cast(ts as date)) as last_seen_date from events group by 1")
def z2(t):
    return Z.run_to_end(Z.seen_dates(events(t, "z2").withColumn("observed_date", F.to_date("ts")), ["user_id"]), "complete", "z2")


@query("z3", "select competitor_id || '|' || id_brand || '|' || id_model || '|' || id_product as identity, previous_date, observed_date, previous_price, current_price from movements")
def z3(t):
    """Days are written as a stream source; the streaming job must find the batch operator's movements."""
    path = scratch(t.spark, "z3-days")
    days = P.with_identity(t.prices).select(F.concat_ws("|", *P.IDENTITY).alias("identity"), "observation_id", "price_kes", "observed_date")
    top = days.groupBy("identity", "observed_date").agg(F.max(F.struct("observation_id", "price_kes")).alias("r")).select("identity", "observed_date", "r.*")
    path, files = Z.deal_by_time(overwrite(top, scratch(t.spark, "z3-top")), "observed_date", path)
    s = t.spark.readStream.schema(top.schema).option("maxFilesPerTrigger", files).parquet(path)
    return Z.movements_by_batch(s, "z3")[0]


@query("z4", "select cast(ts as date) as day, post_url, arg_max(likes, observation_id) as likes, count(*) as n from social group by 1, 2")
def z4(t):
    out = Z.run_to_end(Z.engagement_days(events(t, "z4"), "ts"), "complete", "z4")
    return out.select(F.to_date("window.start").alias("day"), "post_url", "likes", "n")


@query("z5", "select cast(date_trunc('week', ts) as date) as week, event_type, count(*) as n from events group by 1, 2")
def z5(t):
    out = Z.run_to_end(Z.weekly_counts(events(t, "z5"), "ts", "event_type"), "complete", "z5")
    return out.select(F.to_date("window.start").alias("week"), "event_type", "n")

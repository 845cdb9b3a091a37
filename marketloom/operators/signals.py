"""Campaigns, market signals, comparisons and alerts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import date_span
from ..sources.tables import overwrite, scratch
from .prices import concurrent_runs


def campaign_type(c: Column) -> Column:
    """Ordered terms, the first that the text has; null if none."""
    low = T.search_text(c)
    rules = [(("giveaway", "competition", "contest"), "campaign"), (("seminar",), "event"), (("financing",), "financing"), (("flash sale", "flash offers"), "flash_sale"),
             (("clearance sale",), "clearance_sale"), (("night rush",), "limited_time_sale"), (("live demo", "tiktok live"), "live_promotion"), (("monthly offers",), "promotion"),
             (("sale",), "sale"), (("promotion", "promo"), "promotion")]
    return T.first_rule([(T.contains_any(low, terms), name) for terms, name in rules]).cast("string")


#: Campaign names by phrases that must all occur, in order of precedence; a parameter, these are general ones.
NAMES = [(["clearance sale"], "Clearance Sale"), (["monthly offers"], "Monthly Offers")]
#: Phrases that are evidence enough for a campaign, and those that make it one of no single category.
STRONG = ["monthly offers", "clearance sale", "live demo", "flash offers", "sale extended", "giveaway", "competition", "contest"]
BROAD = ["monthly offers", "clearance sale", "flash offers"]
#: Categories by their words, the first with a word in the text.
TOPICS = [
    ("Cooking", ["pressure cooker", "cooker", "cooking", "kitchen"]), ("Laundry", ["laundry", "washing machine", "commercial laundry"]),
    ("Refrigeration", ["refrigerator", "refrigerators", "fridge", "freezer"]), ("Cooking", ["microwave", "microwaves"]), ("General Appliances", ["appliances"]),
]


def offer_value(low: Column) -> Column:
    """What a search text offers: financing in full, percentages with "off" or "discount" as they stand, special deals."""
    percent = F.array_distinct(F.transform(F.regexp_extract_all(low, F.lit(r"\b(\d+% *(?:off|discount)?)"), F.lit(1)), lambda x: F.trim(x)))
    return T.first_rule([
        (F.contains(low, F.lit("100% financing")), "100% financing"), (F.size(percent) > 0, F.array_join(percent, ", ")), (F.contains(low, F.lit("special live deals")), "Special LIVE deals"),
        (F.contains(low, F.lit("special prices")), "Special prices"), (F.contains(low, F.lit("financing")), "100% financing"),
    ]).cast("string")


def campaign_fields(c: Column, posted: Column, names: list[tuple[list[str], str]] = NAMES, strong: list[str] = STRONG) -> Column:
    """struct of type, name, category, offer, start and end date that a post's text names, and whether its evidence is strong.

    A flash sale without a name of its own is a Flash Sale; a text that names no category has none."""
    low = T.search_text(c)
    kind = campaign_type(c)
    every = lambda phrases: reduce(and_, (F.contains(low, F.lit(p)) for p in phrases))
    name = T.first_rule([*((every(p), n) for p, n in names), (kind == "flash_sale", "Flash Sale")]).cast("string")
    category = T.first_rule([(T.contains_any(low, BROAD), "General Appliances"), *((T.contains_any(low, w), k) for k, w in TOPICS)]).cast("string")
    span = date_span(c, posted)
    return F.struct(
        kind.alias("type"), name.alias("name"), category.alias("category"), offer_value(low).alias("offer"),
        span["start_date"].alias("start_date"), span["end_date"].alias("end_date"), T.contains_any(low, strong).alias("strong"),
    )


def campaign_candidates(posts: DataFrame, text: Column, as_of: str, names: list[tuple[list[str], str]] = NAMES, strong: list[str] = STRONG) -> DataFrame:
    """Candidates of posts(competitor_id, observation_id, published_date, post_url): posts with strong evidence, a type and a
    name. Nothing is invented: a candidate without dates has no status."""
    c = posts.withColumn("c", campaign_fields(text, F.col("published_date"), names, strong)).where("c.strong and c.type is not null and c.name is not null")
    rows = c.select("competitor_id", "observation_id", "c.type", F.col("c.name").alias("campaign_name"), "c.category", F.col("c.offer").alias("offer_value"),
                    "c.start_date", "c.end_date", F.col("post_url").alias("source_url"), F.col("published_date").alias("observed_date"))
    return rows.withColumns({"status": campaign_status(as_of), "verification_status": F.lit("VERIFIED"), "confidence": F.lit("high")})


def campaign_status(as_of: str) -> Column:
    """ended, upcoming or active on a date; null without dates."""
    day, s, e = F.lit(as_of).cast("date"), F.col("start_date"), F.col("end_date")
    return T.first_rule([(s.isNull() & e.isNull(), F.lit(None).cast("string")), (e < day, "ended"), (s > day, "upcoming")], "active")


def merge_candidates(df: DataFrame, as_of: str) -> DataFrame:
    """One campaign per competitor and normalised name: its posts, earliest start, latest end, and of category, offer and source
    the first that is stated, by date and id of the posts; General Appliances goes before any other category."""
    order = F.struct("observed_date", "observation_id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    general = F.bool_or(F.coalesce(F.col("category") == "General Appliances", F.lit(False)))
    g = df.groupBy("competitor_id", T.search_text(F.col("campaign_name")).alias("name_key")).agg(
        F.min_by("campaign_name", order).alias("campaign_name"), F.min_by("type", order).alias("type"), F.count_distinct("observation_id").alias("posts"),
        F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), first("offer_value"), first("source_url"),
        F.when(general, "General Appliances").otherwise(F.min_by("category", F.when(F.col("category").isNotNull(), order))).alias("category"), F.max("observed_date").alias("observed_date"),
    )
    return g.withColumns({"status": campaign_status(as_of), "confidence": F.lit("high")})


def resolve_unique(df: DataFrame, competitors: DataFrame) -> DataFrame:
    """competitor_id by name, else by brand, where the match is unique."""
    def lookup(column: str, key: str, name: str) -> DataFrame:
        ids = competitors.groupBy(F.lower(column).alias(key)).agg(F.count_distinct("competitor_id").alias("n"), F.min("competitor_id").alias(name))
        return ids.where("n = 1").drop("n")

    keyed = df.withColumns({"name_key": F.lower("name"), "brand_key": F.lower("brand")})
    j = keyed.join(lookup("competitor_name", "name_key", "by_name"), "name_key", "left").join(lookup("brand_name", "brand_key", "by_brand"), "brand_key", "left")
    return j.withColumn("competitor_id", F.coalesce("by_name", "by_brand"))


SIGNAL = ["signal_type", "subject", "title", "evidence_count", "confidence"]


def _signal(df: DataFrame, kind: str, subject: Column, title: Column, n: Column, confidence: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("signal_type"), subject.cast("string").alias("subject"), title.alias("title"), n.cast("long").alias("evidence_count"), confidence.alias("confidence"))


def pct_text(c: Column) -> Column:
    return F.concat(F.format_number(c, 2), F.lit("%"))


def price_signals(movements: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """One signal per movement; none at all while any identity is ambiguous."""
    gate = ambiguous.agg((F.count("*") == 0).alias("clear"))
    m = movements.crossJoin(F.broadcast(gate)).where("clear")  # one row
    way = F.when(F.col("pct") > 0, "rose").otherwise("fell")
    title = F.concat(F.col("id_product"), F.lit(" "), F.col("id_model"), F.lit(" "), way, F.lit(" on "), F.col("observed_date").cast("string"))
    return _signal(m, "PRODUCT_PRICE_MOVEMENT", F.col("id_brand"), title, F.lit(1), F.lit("HIGH"))


def brand_trends(movements: DataFrame, least: int = 2) -> DataFrame:
    """Brands of which several products moved the same way."""
    way = F.when(F.col("pct") > 0, "increase").otherwise("decrease")
    g = movements.groupBy("id_brand", way.alias("direction")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    title = F.concat("id_brand", F.lit(" multi-product price "), "direction", F.lit(" trend"))
    return _signal(g, "BRAND_PRICE_TREND", F.col("id_brand"), title, F.col("n"), F.lit("HIGH"))


def market_wide(movements: DataFrame, brands: int = 3, least: int = 3) -> DataFrame:
    b, n = F.count_distinct("id_brand"), F.count("*")
    return movements.agg(b.alias("brands"), n.alias("movements"), F.when((b >= brands) & (n >= least), "SUPPORTED").otherwise("INSUFFICIENT").alias("verdict"))


def campaign_signals(campaigns: DataFrame) -> DataFrame:
    """Activity at all, activity of several competitors, and the category with most campaigns (the first seen of equals);
    HIGH only if all campaigns are."""
    sure = F.when(F.bool_and(F.coalesce(F.upper("confidence") == "HIGH", F.lit(False))), "HIGH").otherwise("MEDIUM").alias("c")
    named = campaigns.withColumn("category", F.coalesce("category", F.lit("UNSPECIFIED")))
    every = named.agg(F.count("*").alias("n"), F.count_distinct("competitor_id").alias("competitors"), sure)
    a = _signal(every.where("n > 0"), "CAMPAIGN_ACTIVITY", F.lit(None), F.lit("Verified competitor campaign activity"), F.col("n"), F.col("c"))
    b = _signal(every.where("competitors >= 2"), "MULTI_COMPETITOR_CAMPAIGN", F.lit(None), F.lit("Multi-competitor campaign activity"), F.col("n"), F.col("c"))
    top = named.groupBy("category").agg(F.count("*").alias("n"), F.min("campaign_id").alias("first")).orderBy(F.desc("n"), "first").limit(1)
    title = F.concat(F.lit("Campaign activity concentrated in "), "category")
    return a.unionByName(b).unionByName(_signal(top, "CAMPAIGN_CATEGORY_CONCENTRATION", F.col("category"), title, F.col("n"), every.select("c").scalar()))


def catalogue_signals(summary: DataFrame) -> DataFrame:
    title = F.concat("brand", F.lit(" catalogue persistence"))
    return _signal(summary.where("persistent > 0"), "CATALOGUE_PERSISTENCE", F.col("brand"), title, F.col("persistent"), F.lit("HIGH"))


def concurrency_signals(movements: DataFrame, campaigns: DataFrame, competitors: DataFrame) -> DataFrame:
    """One signal per campaign owner, campaign name and movement (brand, model and dates) where either date of the movement
    lies in a campaign of that owner and name."""
    owners = competitors.select("competitor_id", "competitor_name")
    moved = movements.select("id_brand", "id_model", "previous_date", "observed_date").distinct()
    moved = overwrite(moved, scratch(movements.sparkSession, "moved"))
    met = concurrent_runs(moved, campaigns.join(owners, "competitor_id"), ["competitor_name", "campaign_name"])
    title = F.concat_ws(" ", "id_brand", "id_model", F.lit("and"), "competitor_name", "campaign_name", F.lit("date overlap"))
    return _signal(moved.join(met, ["previous_date", "observed_date"]), "PRICE_CAMPAIGN_CONCURRENCY", F.col("competitor_name"), title, F.lit(2), F.lit("MEDIUM"))


def facts(df: DataFrame, dimension: str, metrics: list[str]) -> DataFrame:
    """Long comparison facts: one row for each subject and metric."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("metric_value")) for m in metrics))
    text = F.concat(F.lit(dimension), F.lit(" "), F.col("r.metric_name"), F.lit(" of "), F.col("subject"))
    return df.select("subject", F.explode(rows).alias("r")).select(F.lit(dimension).alias("dimension"), "subject", "r.metric_name", "r.metric_value", text.alias("summary"))


def price_alerts(movements: DataFrame) -> DataFrame:
    size = F.abs("pct")
    priority = T.first_rule([(size.isNull(), "MEDIUM"), (size >= 20, "HIGH"), (size >= 5, "MEDIUM")], "LOW")
    return movements.select(F.lit("PRICE_MOVEMENT").alias("alert_type"), priority.alias("priority"), F.col("competitor_id").cast("string").alias("subject"),
                            F.concat("id_model", F.lit(" "), F.col("observed_date").cast("string")).alias("title"))


def campaign_alerts(campaigns: DataFrame) -> DataFrame:
    """Verified campaigns that run or will run, always of medium priority."""
    live = campaigns.where("verification_status = 'VERIFIED' and status in ('active', 'upcoming')")
    title = F.concat("campaign_name", F.lit(" - "), F.upper("status")).alias("title")
    return live.select(F.lit("CAMPAIGN_ACTIVITY").alias("alert_type"), F.lit("MEDIUM").alias("priority"), F.col("competitor_id").cast("string").alias("subject"), title)


#: Market-level signals that raise alerts.
PRIORITIES = {"MULTI_COMPETITOR_CAMPAIGN": "HIGH", "CAMPAIGN_CATEGORY_CONCENTRATION": "MEDIUM", "PRICE_CAMPAIGN_CONCURRENCY": "MEDIUM"}


def signal_alerts(signals: DataFrame) -> DataFrame:
    """Alerts of market-level signals, under the signal's own type."""
    p = T.first_rule([(F.col("signal_type") == k, v) for k, v in PRIORITIES.items()], "MEDIUM")
    return signals.where(F.col("signal_type").isin(*PRIORITIES)).select(F.col("signal_type").alias("alert_type"), p.alias("priority"), "subject", "title")


def persistence_alerts(summary: DataFrame) -> DataFrame:
    title = F.concat("brand", F.lit(" catalogue persistence")).alias("title")
    return summary.where("persistent > 0").select(F.lit("CATALOGUE_PERSISTENCE").alias("alert_type"), F.lit("LOW").alias("priority"), F.col("brand").alias("subject"), title)


def evidence_gaps(competitors: DataFrame, evidence: dict[str, DataFrame]) -> DataFrame:
    """Competitors without any row in each evidence table; offered beside the collected alerts."""
    out = competitors.select("competitor_id", "competitor_name")
    for df in evidence.values():
        out = out.join(df.select("competitor_id").distinct(), "competitor_id", "left_anti")
    title = F.concat(F.lit("Limited verified evidence coverage - "), "competitor_name").alias("title")
    return out.select(F.lit("EVIDENCE_GAP").alias("alert_type"), F.lit("LOW").alias("priority"), F.col("competitor_id").cast("string").alias("subject"), title)


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Queries of campaigns, signals, comparisons, alerts, reports and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import news as N
from ..operators import prices as P
from ..operators import quality as Q
from ..operators import reports as R
from ..operators import signals as G
from ..sources.tables import overwrite, scratch
from .bind import AS_OF, BASELINE, VIEWS
from .q_prices import J5
from .registry import query

SUMMARY = f"select brand, count(*) as products, count(*) filter (first_seen_date < last_seen_date) as persistent, count(*) filter (first_seen_date > date '{BASELINE}') as post_baseline from catalogue group by 1"
VERIFIED = "campaigns where verification_status = 'VERIFIED'"
VIEWS |= {
    "summary": SUMMARY,
    "concurrent": J5,
    "brand_trends": "select id_brand, case when pct > 0 then 'increase' else 'decrease' end as direction, count(*) as n from movements group by 1, 2 having count(*) >= 2",
}


def summary(t):
    return t.catalogue.groupBy("brand").agg(F.count("*").alias("products"), F.count_if(F.col("first_seen_date") < F.col("last_seen_date")).alias("persistent"), F.count_if(F.col("first_seen_date") > BASELINE).alias("post_baseline"))


def movements(t):
    return P.detect_movements(t.prices)


# ---------------------------------------------------------------- M: campaigns


#: What the test posts say besides: every branch of names, categories, offers and dates occurs.
POSTED = """post_text || ' ' || case observation_id % 16 when 0 then 'FLASH SALE! 20% off cookers 25th to 27th September, 5% discount, 20% off' when 1 then 'promo on TVs from 3 May' when 2 then 'Giveaway: win a fridge https://x.example/sale'
    when 3 then 'Monthly offers and financing for laundry until 3 oct 2023' when 4 then 'Spring gala! flash offers 22nd Sept – 7th Oct' when 5 then 'contest: flash sale of microwaves, special prices, Dec 28 to Jan 4' when 6 then 'Sale extended, clearance sale: appliances 70% off, March 3, 2024'
    when 7 then '100% financing seminar, live demo, Friday 25th and Sunday 27th September' when 8 then 'spring gala competition, special LIVE deals, 31st June' when 9 then 'Flash offers on freezers 9 - 11 of November 2023 or 1 may' else '' end""".replace("\\u2013", "–")
#: Names of the test campaigns.
CAMPAIGNS = [(["spring gala", "offers"], "Spring Gala Offers"), (["spring gala"], "Spring Gala"), *G.NAMES]


def contains_sql(words, joined=" or "):
    return joined.join(f"contains(low, '{w}')" for w in words)


MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
WEEK = "(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)? )?"
DAYS, IN_YEAR, UP_TO, SAYS = "([0-9]{1,2})(?:st|nd|rd|th)?", "(?: (20[0-9]{2}))?", " ?(?:-|to|until|till|through|and|&) ?", r"(?:\b(until|till|ends|ending|by|from|starts|starting|since) )?"


def groups_sql(pattern, n):
    return "[" + ", ".join(f"regexp_extract(span, '{pattern}', {g})" for g in range(1, n + 1)) + "]"


SPAN_SQL = rf"""(select *, case when r1[5] <> '' then r1 when r2[1] <> '' then [r2[2], r2[1], r2[3], r2[5], r2[4], r2[6]] end as r, case when s1[2] <> '' then s1 when s2[2] <> '' then [s2[1], s2[3], s2[2], s2[4]] end as s from (select *,
    {groups_sql(rf"\b{WEEK}{DAYS}(?: (?:of )?{MONTH}\b)?{IN_YEAR}{UP_TO}{WEEK}{DAYS} (?:of )?{MONTH}\b{IN_YEAR}", 6)} as r1, {groups_sql(rf"\b{MONTH} {DAYS}{IN_YEAR}{UP_TO}(?:{MONTH} )?{DAYS}\b{IN_YEAR}", 6)} as r2,
    {groups_sql(rf"{SAYS}\b{WEEK}{DAYS} (?:of )?{MONTH}\b{IN_YEAR}", 4)} as s1, {groups_sql(rf"{SAYS}\b{MONTH} {DAYS}\b{IN_YEAR}", 4)} as s2 from posted_))"""


def day_sql(y, m, d):
    return f"try_cast({y} || '-' || lpad(cast((strpos('janfebmaraprmayjunjulaugsepoctnovdec', {m}[1:3]) + 2) // 3 as varchar), 2, '0') || '-' || lpad({d}, 2, '0') as date)"


def near_sql(m, d):
    y = "year(published_date)"
    same = day_sql(y, m, d)
    return f"case when {same} - published_date > 183 then {day_sql(y + ' - 1', m, d)} when {same} - published_date < -183 then {day_sql(y + ' + 1', m, d)} else {same} end"


KINDS = [
    (["giveaway", "competition", "contest"], "campaign"), (["seminar"], "event"), (["financing"], "financing"), (["flash sale", "flash offers"], "flash_sale"), (["clearance sale"], "clearance_sale"),
    (["night rush"], "limited_time_sale"), (["live demo", "tiktok live"], "live_promotion"), (["monthly offers"], "promotion"), (["sale"], "sale"), (["promotion", "promo"], "promotion"),
]
VIEWS["posted_"] = rf"""select *, trim(regexp_replace(regexp_replace(translate(lower(said), '{chr(0x2013)}{chr(0x2014)}', '--'), '[^a-z0-9&-]', ' ', 'g'), ' +', ' ', 'g')) as span,
    trim(regexp_replace(regexp_replace(regexp_replace(lower(said), 'https?://\S+', ' ', 'g'), '[^a-z0-9%&+\- ]', ' ', 'g'), '\s+', ' ', 'g')) as low from (select *, {POSTED} as said from social)"""
VIEWS["dated"] = f"""select *, case when r is not null then case when a is not null and b is not null then if(b < a and r[3] = '' and r[6] <> '', cast(a - interval 12 month as date), a) end when s[1] not in ('until', 'till', 'ends', 'ending', 'by') then o end as start_date,
    case when r is not null then case when a is not null and b is not null then if(b < a and r[6] = '', cast(b + interval 12 month as date), b) end when s[1] not in ('from', 'starts', 'starting', 'since') then o end as end_date
    from (select *, {day_sql("if(r[6] <> '', r[6], cast(year(a) as varchar))", "m2", "r[4]")} as b from
    (select *, case when r[3] <> '' then {day_sql("r[3]", "m1", "r[1]")} when r[6] <> '' then {day_sql("r[6]", "m1", "r[1]")} else {near_sql("m1", "r[1]")} end as a, case when s[4] <> '' then {day_sql("s[4]", "s[3]", "s[2]")} else {near_sql("s[3]", "s[2]")} end as o
    from (select *, if(r[2] = '', r[5], r[2]) as m1, if(r[5] = '', r[2], r[5]) as m2 from {SPAN_SQL})))"""
VIEWS["campaign_posts"] = rf"""select competitor_id, observation_id, published_date, post_url, kind as type, name, category, offer, start_date, end_date, strong from (select *,
    case when {contains_sql(["spring gala", "offers"], " and ")} then 'Spring Gala Offers' when contains(low, 'spring gala') then 'Spring Gala' when contains(low, 'clearance sale') then 'Clearance Sale' when contains(low, 'monthly offers') then 'Monthly Offers' when kind = 'flash_sale' then 'Flash Sale' end as name
    from (select *, case {" ".join(f"when {contains_sql(w)} then '{k}'" for w, k in KINDS)} end as kind,
    case when {contains_sql(["monthly offers", "clearance sale", "flash offers"])} then 'General Appliances' when {contains_sql(["cooker", "cooking", "kitchen"])} then 'Cooking' when {contains_sql(["laundry", "washing machine"])} then 'Laundry'
        when {contains_sql(["refrigerator", "fridge", "freezer"])} then 'Refrigeration' when contains(low, 'microwave') then 'Cooking' when contains(low, 'appliances') then 'General Appliances' end as category,
    case when contains(low, '100% financing') then '100% financing' when len(pct) > 0 then array_to_string(pct, ', ') when contains(low, 'special live deals') then 'Special LIVE deals' when contains(low, 'special prices') then 'Special prices' when contains(low, 'financing') then '100% financing' end as offer,
    {contains_sql(["monthly offers", "clearance sale", "live demo", "flash offers", "sale extended", "giveaway", "competition", "contest"])} as strong
    from (select *, list_filter(raw, lambda x, i: list_position(raw, x) = i) as pct from (select *, list_transform(regexp_extract_all(low, '\b(\d+% *(?:off|discount)?)', 1), lambda x: trim(x)) as raw from dated))))"""
STATUS_SQL = f"case when start_date is null and end_date is null then null when end_date < date '{AS_OF}' then 'ended' when start_date > date '{AS_OF}' then 'upcoming' else 'active' end"
POSTED_ON = "2023-10-01"
VIEWS["candidates"] = f"select competitor_id, observation_id, type, name as campaign_name, category, offer as offer_value, start_date, end_date, post_url as source_url, published_date as observed_date, {STATUS_SQL.replace(AS_OF, POSTED_ON)} as status from campaign_posts where strong and type is not null and name is not null"


def candidates(t):
    return G.campaign_candidates(t.social, F.expr(POSTED), POSTED_ON, CAMPAIGNS)


@query("m1", "select *, 'high' as confidence from candidates")
def m1(t):
    return candidates(t).drop("verification_status")


@query("m2", f"""select *, {STATUS_SQL.replace(AS_OF, POSTED_ON)} as status, 'high' as confidence from (select competitor_id, lower(campaign_name) as name_key, arg_min(campaign_name, o) as campaign_name, arg_min(type, o) as type, count(distinct observation_id) as posts, min(start_date) as start_date, max(end_date) as end_date,
    arg_min(offer_value, o) filter (offer_value is not null) as offer_value, arg_min(source_url, o) as source_url, case when bool_or(coalesce(category = 'General Appliances', false)) then 'General Appliances' else arg_min(category, o) filter (category is not null) end as category, max(observed_date) as observed_date
    from (select *, {{'d': observed_date, 'i': observation_id}} as o from candidates) group by 1, 2)""")
def m2(t):
    return G.merge_candidates(candidates(t), POSTED_ON)


@query("m3", f"select campaign_id, case when start_date is null and end_date is null then null when end_date < date '{AS_OF}' then 'ended' when start_date > date '{AS_OF}' then 'upcoming' else 'active' end as status from campaigns")
def m3(t):
    return t.campaigns.select("campaign_id", G.campaign_status(AS_OF).alias("status"))


@query("m4", "select c.campaign_id, count(s.observation_id) as posts, count(s.observation_id) - count(distinct s.observation_id) as duplicates from campaigns c left join social s on s.observation_id = c.campaign_id % 10000 group by 1")
def m4(t):
    links = t.campaigns.select("campaign_id", (F.col("campaign_id") % 10000).alias("observation_id"))
    posts = t.social.select("observation_id", F.col("observation_id").alias("post"))
    return links.join(posts, "observation_id", "left").groupBy("campaign_id").agg(F.count("post").alias("posts"), (F.count("post") - F.count_distinct("post")).alias("duplicates"))


# ---------------------------------------------------------------- N: signals

N1 = """select 'PRODUCT_PRICE_MOVEMENT' as signal_type, id_brand as subject, id_product || ' ' || id_model || case when pct > 0 then ' rose' else ' fell' end || ' on ' || observed_date as title, cast(1 as bigint) as evidence_count, 'HIGH' as confidence
    from movements where {gate}"""


@query("n1", N1.format(gate="(select count(*) from latest where n_rows > 1) = 0"))
def n1(t):
    """The gate closes if any identity is ambiguous."""
    return G.price_signals(movements(t), P.ambiguous_identities(t.prices))


@query("n1_clear", N1.format(gate="true"))
def n1_clear(t):
    """The same with an empty set of ambiguous identities, so the gate is open."""
    return G.price_signals(movements(t), P.ambiguous_identities(t.prices).where("ambiguous_days < 0"))


N2 = "select 'BRAND_PRICE_TREND' as signal_type, id_brand as subject, id_brand || ' multi-product price ' || direction || ' trend' as title, n as evidence_count, 'HIGH' as confidence from brand_trends"


@query("n2", N2)
def n2(t):
    return G.brand_trends(movements(t))


@query("n3", "select count(distinct id_brand) as brands, count(*) as movements, case when count(distinct id_brand) >= 3 and count(*) >= 3 then 'SUPPORTED' else 'INSUFFICIENT' end as verdict from movements")
def n3(t):
    return G.market_wide(movements(t))


SURE = f"(select case when bool_and(confidence = 'HIGH') then 'HIGH' else 'MEDIUM' end from {VERIFIED})"
N4 = f"""select 'CAMPAIGN_ACTIVITY' as signal_type, cast(null as varchar) as subject, 'Verified competitor campaign activity' as title, count(*) as evidence_count, {SURE} as confidence from {VERIFIED} having count(*) > 0
    union all select 'MULTI_COMPETITOR_CAMPAIGN', null, 'Multi-competitor campaign activity', count(*), {SURE} from {VERIFIED} having count(distinct competitor_id) >= 2
    union all select * from (select 'CAMPAIGN_CATEGORY_CONCENTRATION', category, 'Campaign activity concentrated in ' || category, count(*), {SURE} from {VERIFIED} group by category order by count(*) desc, min(campaign_id) limit 1)"""


@query("n4", N4)
def n4(t):
    return G.campaign_signals(t.campaigns.where("verification_status = 'VERIFIED'"))


@query("n5", "select 'CATALOGUE_PERSISTENCE' as signal_type, brand as subject, brand || ' catalogue persistence' as title, persistent as evidence_count, 'HIGH' as confidence from summary where persistent > 0")
def n5(t):
    return G.catalogue_signals(summary(t))


N6 = """select 'PRICE_CAMPAIGN_CONCURRENCY' as signal_type, competitor_name as subject, title, cast(2 as bigint) as evidence_count, 'MEDIUM' as confidence
    from (select distinct o.competitor_name, p.id_brand || ' ' || p.id_model || ' and ' || o.competitor_name || ' ' || p.campaign_name || ' date overlap' as title, p.previous_date, p.observed_date
    from concurrent p join competitors o on o.competitor_id = p.campaign_competitor)"""


def concurrency(t):
    return G.concurrency_signals(movements(t), t.campaigns.where("verification_status = 'VERIFIED'"), t.competitors)


@query("n6", N6)
def n6(t):
    return concurrency(t)


STATE_SQL = "case when confidence = 'HIGH' then 'CONFIRMED' else 'REVIEW' end"


@query("a21", f"select signal_type, {STATE_SQL} as status, count(*) as n from ({N2} union all {N4} union all select 'CATALOGUE_PERSISTENCE', brand, '', persistent, 'HIGH' from summary where persistent > 0) group by 1, 2")
def a21(t):
    signals = G.union_all(G.brand_trends(movements(t)), G.campaign_signals(t.campaigns.where("verification_status = 'VERIFIED'")), G.catalogue_signals(summary(t)))
    return signals.groupBy("signal_type", F.expr(STATE_SQL).alias("status")).agg(F.count("*").alias("n"))


@query("n7", """select 'price' as evidence, (select count(*) from movements) as n, case when (select count(*) from movements) >= 3 then 'SUFFICIENT' else 'INSUFFICIENT' end as verdict
    union all select 'campaign', count(*), case when count(*) >= 2 then 'SUFFICIENT' else 'INSUFFICIENT' end from campaigns where verification_status = 'VERIFIED'
    union all select 'catalogue', coalesce(cast(sum(persistent) as bigint), 0), case when coalesce(sum(persistent), 0) >= 1 then 'SUFFICIENT' else 'INSUFFICIENT' end from summary
    union all select 'social', count(distinct competitor_id), case when count(distinct competitor_id) >= 2 then 'SUFFICIENT' else 'INSUFFICIENT' end from social""")
def n7(t):
    def one(name, df, n, least):
        return df.agg(F.lit(name).alias("evidence"), n.alias("n"), F.when(n >= least, "SUFFICIENT").otherwise("INSUFFICIENT").alias("verdict"))

    return G.union_all(one("price", movements(t), F.count("*"), 3), one("campaign", t.campaigns.where("verification_status = 'VERIFIED'"), F.count("*"), 2),
                       one("catalogue", summary(t), F.coalesce(F.sum("persistent"), F.lit(0)), 1), one("social", t.social, F.count_distinct("competitor_id"), 2))


# ---------------------------------------------------------------- K: comparisons


def _facts_sql(dimension, source, metrics):
    return " union all ".join(f"select '{dimension}' as dimension, subject, '{m}' as metric_name, cast({m} as double) as metric_value, '{dimension} {m} of ' || subject as summary from ({source})" for m in metrics)


K1 = " union all ".join([
    _facts_sql("price", "select cast(competitor_id as varchar) as subject, count(*) as observations, count(distinct model) as models from prices group by 1", ["observations", "models"]),
    _facts_sql("campaign", "select cast(competitor_id as varchar) as subject, count(*) as campaigns, count(*) filter (status = 'active') as active from campaigns group by 1", ["campaigns", "active"]),
    _facts_sql("social", "select cast(competitor_id as varchar) as subject, count(*) as posts, sum(likes) as likes from social group by 1", ["posts", "likes"]),
    _facts_sql("catalogue", "select brand as subject, products, persistent from summary", ["products", "persistent"]),
    _facts_sql("signal", "select signal_type as subject, count(*) as signals from (" + N4 + ") group by 1", ["signals"]),
])


@query("k1", K1)
def k1(t):
    subject = F.col("competitor_id").cast("string").alias("subject")
    p = t.prices.groupBy(subject).agg(F.count("*").alias("observations"), F.count_distinct("model").alias("models"))
    c = t.campaigns.groupBy(subject).agg(F.count("*").alias("campaigns"), F.count_if(F.col("status") == "active").alias("active"))
    s = t.social.groupBy(subject).agg(F.count("*").alias("posts"), F.sum("likes").alias("likes"))
    signals = G.campaign_signals(t.campaigns.where("verification_status = 'VERIFIED'")).groupBy(F.col("signal_type").alias("subject")).agg(F.count("*").alias("signals"))
    return G.union_all(G.facts(p, "price", ["observations", "models"]), G.facts(c, "campaign", ["campaigns", "active"]), G.facts(s, "social", ["posts", "likes"]),
                       G.facts(summary(t).withColumnRenamed("brand", "subject"), "catalogue", ["products", "persistent"]), G.facts(signals, "signal", ["signals"]))


# ---------------------------------------------------------------- L: alerts

L1 = """select 'PRICE_MOVEMENT' as alert_type, case when pct is null then 'MEDIUM' when abs(pct) >= 20 then 'HIGH' when abs(pct) >= 5 then 'MEDIUM' else 'LOW' end as priority, cast(competitor_id as varchar) as subject, id_model || ' ' || observed_date as title from movements"""
L2 = """select 'CAMPAIGN_ACTIVITY' as alert_type, 'MEDIUM' as priority, cast(competitor_id as varchar) as subject, campaign_name || ' - ' || upper(status) as title from campaigns where verification_status = 'VERIFIED' and status in ('active', 'upcoming')"""
L3 = f"""select signal_type as alert_type, if(signal_type = 'MULTI_COMPETITOR_CAMPAIGN', 'HIGH', 'MEDIUM') as priority, subject, title from ({N4} union all {N6}) where signal_type in ('MULTI_COMPETITOR_CAMPAIGN', 'CAMPAIGN_CATEGORY_CONCENTRATION', 'PRICE_CAMPAIGN_CONCURRENCY')"""
L4 = "select 'CATALOGUE_PERSISTENCE' as alert_type, 'LOW' as priority, brand as subject, brand || ' catalogue persistence' as title from summary where persistent > 0"


@query("l1", L1)
def l1(t):
    return G.price_alerts(movements(t))


@query("l2", L2)
def l2(t):
    return G.campaign_alerts(t.campaigns)


def market_signals(t):
    return G.campaign_signals(t.campaigns.where("verification_status = 'VERIFIED'")).unionByName(concurrency(t))


@query("l3", L3)
def l3(t):
    return G.signal_alerts(market_signals(t))


@query("l4", L4)
def l4(t):
    return G.persistence_alerts(summary(t))


PROSPECTS = "(select competitor_id, competitor_name from competitors union all select competitor_id + 1000000, 'New ' || competitor_name from competitors)"


@query("l5", f"""select 'EVIDENCE_GAP' as alert_type, 'LOW' as priority, cast(competitor_id as varchar) as subject, 'Limited verified evidence coverage - ' || competitor_name as title from {PROSPECTS}
    where competitor_id not in (select competitor_id from social) and competitor_id not in (select competitor_id from campaigns where verification_status = 'VERIFIED') and competitor_id not in (select competitor_id from prices)""")
def l5(t):
    """Besides the competitors, as many new ones that nothing is known of yet."""
    known = t.competitors.select("competitor_id", "competitor_name")
    new = known.select((F.col("competitor_id") + 1000000).alias("competitor_id"), F.concat(F.lit("New "), "competitor_name").alias("competitor_name"))
    return G.evidence_gaps(known.unionByName(new), {"social": t.social, "campaign": t.campaigns.where("verification_status = 'VERIFIED'"), "price": t.prices})


def alerts(t):
    """Movements are found once and written: alerts of their own and the signals of concurrent campaigns read them."""
    moved, verified = overwrite(movements(t), scratch(t.spark, "movements")), t.campaigns.where("verification_status = 'VERIFIED'")
    signals = G.campaign_signals(verified).unionByName(G.concurrency_signals(moved, verified, t.competitors))
    return G.union_all(G.price_alerts(moved), G.campaign_alerts(t.campaigns), G.signal_alerts(signals), G.persistence_alerts(summary(t)))


@query("l6", f"select alert_type, priority, count(*) as n, count(*) - count(distinct coalesce(subject, '') || '|' || title) as duplicates from ({L1} union all {L2} union all {L3} union all {L4}) group by 1, 2")
def l6(t):
    return alerts(t).groupBy("alert_type", "priority").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct(F.coalesce("subject", F.lit("")), "title")).alias("duplicates"))


@query("u6", f"{L1} union all {L2} union all {L3} union all {L4}")
def u6(t):
    return alerts(t)


# ---------------------------------------------------------------- R: reports


WEEK = "(select arg_max(scan_week, observed_date) from findings where confidence = 'HIGH')"


@query("r1", f"""select f.finding_type as dataset, f.finding_id, f.brand, f.category, f.observed_date, f.source_url, case f.finding_type when 'price' then p.product_name when 'promotion' then 'offer' else f.summary end as item,
    case f.finding_type when 'price' then p.model when 'promotion' then f.source_type else f.confidence end as kind, case f.finding_type when 'price' then p.price_kes when 'promotion' then p.discount end as value
    from findings f join prices p on f.observation_id = p.observation_id and f.summary = p.product_name where f.scan_week = {WEEK}""")
def r1(t):
    """Prices, promotions and news of the last week with a sure finding: each header with its own child columns."""
    week = t.findings.where("confidence = 'HIGH'").agg(F.max_by("scan_week", "observed_date").alias("scan_week"))
    f = t.findings.join(F.broadcast(week), "scan_week")  # one row
    child = t.prices.select("observation_id", "product_name", "model", "price_kes", "discount").withColumnRenamed("product_name", "summary")

    def one(kind, item, label, value):
        rows = f.where(F.col("finding_type") == kind).join(child, ["observation_id", "summary"])
        return rows.select(F.lit(kind).alias("dataset"), "finding_id", "brand", "category", "observed_date", "source_url", item.alias("item"), F.col(label).alias("kind"), value.cast("double").alias("value"))

    news = one("news", F.col("summary"), "confidence", F.lit(None))
    return one("price", F.col("summary"), "model", F.col("price_kes")).unionByName(one("promotion", F.lit("offer"), "source_type", F.col("discount"))).unionByName(news)


@query("r2", """select c.campaign_type, coalesce(c.status, 'UNSPECIFIED') as status, count(*) as campaigns, count(s.observation_id) as posts from campaigns c left join social s on s.observation_id = c.campaign_id % 10000 group by 1, 2""")
def r2(t):
    links = t.campaigns.select("campaign_type", F.coalesce("status", F.lit("UNSPECIFIED")).alias("status"), (F.col("campaign_id") % 10000).alias("observation_id"))
    j = links.join(t.social.select("observation_id", F.lit(1).alias("post")), "observation_id", "left")
    return j.groupBy("campaign_type", "status").agg(F.count("*").alias("campaigns"), F.count("post").alias("posts"))


#: Questions as the binding has them: what is asked, the scope's name and its subjects, for every second one none.
SAID = """case conv_id % 9 when 0 then 'campaign report' when 1 then 'active campaigns' when 2 then 'upcoming campaigns' when 3 then 'any alerts' when 4 then 'how is the market' when 5 then 'facebook activity'
    when 6 then 'catalogue coverage' when 7 then 'compare them' else 'what are they doing' end"""
NAMED = "case when conv_id % 2 = 0 then case conv_id % 9 when 6 then 'Brand#' || (1 + conv_id % 4) || (1 + conv_id % 5) when 7 then 'A' || (conv_id % 90) || ' and B' when 8 then 'Supplier ' || (conv_id % 100) else 'Supplier ' || (conv_id % 130) end end"
SCOPE = "case when conv_id % 2 = 0 then case conv_id % 9 when 6 then lower('Brand#' || (1 + conv_id % 4) || (1 + conv_id % 5)) when 7 then (conv_id % 90) || ',' || (conv_id % 90 + 1) when 8 then cast(conv_id % 100 as varchar(20)) else cast(conv_id % 130 as varchar(20)) end end"
ROUTED = f"""select conv_id, turn, case conv_id % 9 when 0 then 'CAMPAIGNS' when 1 then 'CAMPAIGNS_ACTIVE' when 2 then 'CAMPAIGNS_UPCOMING' when 3 then 'STRATEGIC_ALERTS' when 4 then 'MARKET_TRENDS' when 5 then 'SOCIAL_EVIDENCE'
    when 6 then 'PRODUCT_CATALOGUE' when 7 then 'COMPETITOR_COMPARISON' else if(conv_id % 2 = 0, 'COMPETITOR_ACTIVITY', 'UNSUPPORTED') end as intent, {NAMED} as named, {SCOPE} as scope from questions"""
#: What the bound tables lack of an evidence table's columns.
OFFER, SOURCE = "'KES ' || cast(floor(offer_value) as bigint)", "case when campaign_id % 4 <> 0 then 'https://c' || campaign_id || '.example.com/' end"
PLACED = "coalesce(cast(start_date as {text}), '9999-12-31') || lpad(cast(campaign_id as {text}), 12, '0')"


def _span(a, b):
    return f"case when {a} is null and {b} is null then 'date not recorded' when {a} is null then cast({b} as varchar) when {b} is null or {a} = {b} then cast({a} as varchar) else {a} || ' to ' || {b} end"


NONE = "'date not recorded'"
_CAMPAIGN = f"""select '{{0}}' as intent, cast(competitor_id as varchar) as subject, {PLACED.format(text='varchar')} as place, campaign_name || ' (' || {_span('start_date', 'end_date')} || ') - ' || {OFFER} || ' - category: ' || category as line,
    campaign_name || ': verification=' || verification_status || ', confidence=' || confidence || ', source=' || coalesce({SOURCE}, 'not recorded') as evidence, campaign_name || ' - ' || {_span('start_date', 'end_date')} as brief from campaigns where {{1}}"""
LINES_SQL = " union all ".join([
    _CAMPAIGN.format("CAMPAIGNS", "true"), _CAMPAIGN.format("CAMPAIGNS_ACTIVE", "status = 'active'"), _CAMPAIGN.format("CAMPAIGNS_UPCOMING", "status = 'upcoming'"),
    f"select 'STRATEGIC_ALERTS', lower(subject), title, '[' || priority || '] ' || title || ' - ' || alert_type, title || ': source=' || lower(alert_type) || ', period=' || {NONE} || ', confidence=not recorded', title || ' - priority=' || priority from ({L2} union all {L4})",
    f"select 'MARKET_TRENDS', lower(subject), title, title || ' - ' || signal_type || ' - ' || {STATE_SQL} || ' - ' || {NONE}, title || ': evidence_count=' || evidence_count || ', confidence=' || confidence, title || ' - status=' || {STATE_SQL} from ({N4} union all select 'CATALOGUE_PERSISTENCE', brand, brand || ' catalogue persistence', persistent, 'HIGH' from summary where persistent > 0)",
    """select 'SOCIAL_EVIDENCE', cast(competitor_id as varchar), lpad(cast(observation_id as varchar), 12, '0'), platform || ' - ' || observed_date || ' - ' || if(length(post_text) > 180, substr(post_text, 1, 177) || '...', post_text),
    platform || ' / ' || account_name || ': published=' || published_date || ', observed=' || observed_date || ', verification=' || verification_status || ', confidence=not recorded', platform || ' - observed=' || observed_date from social""",
    """select 'PRODUCT_CATALOGUE', lower(brand), brand, brand || ': ' || count(*) || ' tracked products (' || min(first_seen_date) || ' to ' || max(last_seen_date) || ')', brand || ': ' || count(*) || ' products, first_seen=' || min(first_seen_date) || ', last_seen=' || max(last_seen_date), '' from catalogue group by brand""",
    f"""select 'COMPETITOR_COMPARISON', competitor_id, dimension, 'Supplier ' || competitor_id || ' - ' || dimension || ' - ' || metric || ' - observations=' || n || coalesce(' | value=' || v, '') || ' - period=' || {_span('a', 'b')} || ' - coverage=TRACKED',
    'Supplier ' || competitor_id || ': ' || dimension || ' / ' || metric || '; observations=' || n || '; period=' || {_span('a', 'b')} || '; coverage=TRACKED; confidence=not recorded; evidence=' || dimension || ' rows', '' from (
    select cast(competitor_id as varchar) as competitor_id, 'price' as dimension, 'observations' as metric, count(*) as n, cast(null as bigint) as v, min(observed_date) as a, max(observed_date) as b from prices group by 1
    union all select cast(competitor_id as varchar), 'social', 'likes', count(*), sum(likes), min(observed_date), max(observed_date) from social group by 1)""",
])


def evidence_lines(t):
    placed = F.expr(PLACED.format(text="string"))
    campaigns = t.campaigns.withColumn("source_url", F.expr(SOURCE)).withColumn("offer_value", F.expr(OFFER))
    no = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    alerts = G.campaign_alerts(t.campaigns).unionByName(G.persistence_alerts(summary(t))).select("*", F.lower("alert_type").alias("evidence_source"), *no("period_start", "period_end", "confidence"))
    signals = G.campaign_signals(t.campaigns.where("verification_status = 'VERIFIED'")).unionByName(G.catalogue_signals(summary(t))).select("*", F.expr(STATE_SQL).alias("status"), *no("start_date", "end_date"))
    posts = t.social.select("*", *no("confidence"))
    tracked = t.catalogue.groupBy(F.col("brand").alias("catalogue")).agg(F.count("*").alias("product_count"), F.min("first_seen_date").alias("first_seen"), F.max("last_seen_date").alias("last_seen"))

    def facts(df, dimension, metric, value):
        g = df.groupBy("competitor_id").agg(F.count("*").alias("observation_count"), value.cast("long").alias("metric_value"), F.min("observed_date").alias("period_start"), F.max("observed_date").alias("period_end"))
        return g.select("*", F.lit(dimension).alias("dimension"), F.lit(metric).alias("metric_name"))

    both = facts(t.prices, "price", "observations", F.max(F.lit(None))).unionByName(facts(t.social, "social", "likes", F.sum("likes")))
    both = both.select("*", F.concat(F.lit("Supplier "), "competitor_id").alias("competitor_name"), F.lit("TRACKED").alias("coverage_status"), F.concat("dimension", F.lit(" rows")).alias("evidence_summary"), *no("brand", "confidence"))
    return G.union_all(
        A.campaign_lines(campaigns, placed), A.campaign_lines(campaigns.where("status = 'active'"), placed, "CAMPAIGNS_ACTIVE"), A.campaign_lines(campaigns.where("status = 'upcoming'"), placed, "CAMPAIGNS_UPCOMING"),
        A.alert_lines(alerts, F.col("title")), A.trend_lines(signals, F.col("title")), A.social_lines(posts, F.lpad(F.col("observation_id").cast("string"), 12, "0")),
        A.catalogue_lines(tracked, F.col("catalogue")), A.comparison_lines(both, F.col("dimension")),
    )


#: By intent: what precedes the lines, what stands without any, lines shown.
HEADS_SQL = """(values ('CAMPAIGNS', 'The current evidence set contains # campaign@:', 'No campaigns were retrieved% in the current evidence set.', 20), ('CAMPAIGNS_ACTIVE', 'The current evidence set contains # campaign@:', 'No campaigns were retrieved% in the current evidence set.', 20),
    ('CAMPAIGNS_UPCOMING', 'The current evidence set contains # upcoming campaign@:', 'No upcoming campaigns were retrieved% in the current evidence set.', 20), ('STRATEGIC_ALERTS', '# open strategic alert@ were retrieved:', 'No open strategic alerts were retrieved%.', 20),
    ('MARKET_TRENDS', '# market-trend record@ were retrieved:', 'No matching market-trend records were retrieved%.', 20), ('SOCIAL_EVIDENCE', '# social observation@ were retrieved:', 'No matching social evidence was retrieved%.', 10),
    ('PRODUCT_CATALOGUE', 'Tracked catalogue coverage:', 'No matching tracked catalogue summary was retrieved%.', 20), ('COMPETITOR_COMPARISON', '# comparison records were retrieved:', 'No matching competitor comparison records were retrieved%.', 20),
    ('COMPETITOR_ACTIVITY', 'Current documented activity%:', 'No current evidence was retrieved%.', 5)) as h(intent, said, none_said, most)"""
PARTS_SQL = """(values ('CAMPAIGNS_ACTIVE', 1, 'Active campaigns', 'Campaign'), ('CAMPAIGNS_UPCOMING', 2, 'Upcoming campaigns', 'Upcoming campaign'), ('STRATEGIC_ALERTS', 3, 'Open strategic alerts', 'Alert'),
    ('SOCIAL_EVIDENCE', 4, 'Social observations', 'Social'), ('MARKET_TRENDS', 5, 'Market-trend records involving this scope', 'Trend')) as p(part, pos, many, one)"""


@query("r3", f"""with routed as ({ROUTED}), lines as ({LINES_SQL}), asked as (select distinct intent, named, scope from routed),
    fan as (select a.*, p.part, p.pos as part_at, p.many, p.one from asked a join {PARTS_SQL} on a.intent = 'COMPETITOR_ACTIVITY' union all select *, intent, 0, null, null from asked where intent <> 'COMPETITOR_ACTIVITY'),
    met as (select f.intent, f.named, f.part_at, f.many, f.one, l.line, l.evidence, l.brief, row_number() over w as pos, count(*) over (partition by f.intent, f.named, f.part) as n from fan f
        join lines l on l.intent = f.part and ((f.scope is null and f.intent <> 'COMPETITOR_COMPARISON') or list_contains(string_split(f.scope, ','), l.subject)) window w as (partition by f.intent, f.named, f.part order by l.place, l.line, l.evidence)),
    done as (select m.intent, m.named, sum(n) filter (pos = 1) as n, string_agg(case when one is not null then many || ': ' || n else line end, chr(10) || '- ' order by part_at, pos) filter (pos = 1 or (one is null and pos <= most)) as body, least(any_value(most), max(pos)) as listed,
        string_agg(coalesce(one || ': ' || brief, evidence), ' | ' order by part_at, pos) filter (pos <= most) as evidence from met m join {HEADS_SQL} on h.intent = m.intent group by 1, 2)
    select q.conv_id, q.turn, q.intent, q.named, cast(coalesce(d.n, 0) as bigint) as n_rows, coalesce(d.evidence, '') as evidence,
    replace(replace(replace(case when d.n is null then h.none_said else h.said end, '#', coalesce(cast(d.n as varchar), '')), '@', if(d.n = 1, '', 's')), '%', coalesce(' for ' || q.named, ''))
        || case when d.n is null then '' else chr(10) || '- ' || d.body || case when q.intent <> 'COMPETITOR_ACTIVITY' and d.n > d.listed then chr(10) || '- ...and ' || cast(d.n - d.listed as bigint) || ' additional.' else '' end end as answer
    from routed q left join {HEADS_SQL} on h.intent = q.intent left join done d on d.intent = q.intent and d.named is not distinct from q.named""")
def r3(t):
    """The answer of every question, with the evidence of the lines it shows."""
    named = F.expr(NAMED)
    about = F.when(F.col("conv_id") % 9 == 8, named)
    routed = t.questions.select("conv_id", "turn", R.question_intent(F.expr(SAID), about).alias("intent"), named.alias("named"), F.split(F.expr(SCOPE), ",").alias("scope"))
    return A.compose(routed, evidence_lines(t)).select("conv_id", "turn", "intent", "named", "n_rows", "answer", F.concat_ws(" | ", "evidence").alias("evidence"))


@query("r4", """select state, count(*) as n from (select case when scope_status <> 'IN_SCOPE' then 'skipped' when exists (select 1 from news s where (s.news_id % 700 < 100 or s.news_id >= 700)
    and (s.news_id = n.news_id or (s.publisher = n.publisher and s.news_id % 700 = n.news_id % 700))) then 'duplicate' when regexp_matches(lower(coalesce(body, '')), '(^|[^a-z0-9])the([^a-z0-9]|$)') then 'finding' else 'market_news' end as state from news n) group by 1""")
def r4(t):
    rows = t.news.withColumn("identity", T.url_identity(F.col("source_url")))
    stored = rows.where("news_id % 700 < 100 or news_id >= 700").select("news_id", "identity")
    named = rows.withColumn("entities", N.terms_in(F.coalesce("body", F.lit("")), ["license", "the"]))
    return N.route(named.withColumn("entity", N.attribute(F.col("entities"), F.col("headline"), ["the"])), stored).groupBy("state").agg(F.count("*").alias("n"))


RANKS = {"HIGH": 1, "MEDIUM": 2, "LOW": 3}


@query("r5", f"""select 'campaigns' as view, case status when 'active' then 1 else 2 end as rank, cast(coalesce(start_date, date '9999-12-31') as varchar) as sort, cast(campaign_id as varchar) as key from campaigns where status in ('active', 'upcoming')
    union all select 'prices', 1, cast(observed_date as varchar), cast(observation_id as varchar) from findings where finding_type = 'price'
    union all select 'social', 1, cast(observed_date as varchar), cast(observation_id as varchar) from social
    union all select 'alerts', case priority when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end, alert_type, title from ({L1} union all {L2})
    union all select 'trends', 1, signal_type, title from ({N2} union all {N4})
    union all select 'comparisons', 1, subject, dimension || ' ' || metric_name from ({_facts_sql("price", "select cast(competitor_id as varchar) as subject, count(*) as observations, count(distinct model) as models from prices group by 1", ["observations", "models"])})""")
def r5(t):
    """The evidence views, each with its rank, sort key and row key; the whole is range-sorted by view, rank and key."""
    view = lambda name, df, rank, sort, key: df.select(F.lit(name).alias("view"), rank.cast("int").alias("rank"), sort.cast("string").alias("sort"), key.cast("string").alias("key"))
    one, subject = F.lit(1), F.col("competitor_id").cast("string").alias("subject")
    campaigns = t.campaigns.where("status in ('active', 'upcoming')")
    start = F.coalesce("start_date", F.lit("9999-12-31").cast("date"))
    raised = G.price_alerts(movements(t)).unionByName(G.campaign_alerts(t.campaigns))
    rank = T.first_rule([(F.col("priority") == k, v) for k, v in RANKS.items()], 4)
    trends = G.brand_trends(movements(t)).unionByName(G.campaign_signals(t.campaigns.where("verification_status = 'VERIFIED'")))
    facts = G.facts(t.prices.groupBy(subject).agg(F.count("*").alias("observations"), F.count_distinct("model").alias("models")), "price", ["observations", "models"])
    out = G.union_all(
        view("campaigns", campaigns, F.when(F.col("status") == "active", 1).otherwise(2), start, F.col("campaign_id")),
        view("prices", t.findings.where("finding_type = 'price'"), one, F.col("observed_date"), F.col("observation_id")),
        view("social", t.social, one, F.col("observed_date"), F.col("observation_id")),
        view("alerts", raised, rank, F.col("alert_type"), F.col("title")), view("trends", trends, one, F.col("signal_type"), F.col("title")),
        view("comparisons", facts, one, F.col("subject"), F.concat_ws(" ", "dimension", "metric_name")),
    )
    return out.orderBy("view", "rank", "sort", "key")


# ---------------------------------------------------------------- Q: data quality


#: Headers and children with planted gaps: unknown competitors and runs, children without header, headers without child.
HEADS = """select finding_id, finding_type, case when observation_id % 97 = 0 then 100000 + competitor_id else competitor_id end as competitor_id,
    case when observation_id % 89 = 0 then -observation_id else observation_id // 10 end as run_id from findings"""
CHILDREN = """select case when observation_id % 83 = 0 then 'X' else 'F' end || observation_id as finding_id, finding_type from findings where observation_id % 79 <> 0"""
CHECKS = [("competitor reference", "competitor_id", "select competitor_id from competitors"), ("run reference", "run_id", "select run_id from runs")]


@query("q1", " union all ".join([
    *(f"select '{n}' as \"check\", cast({c} as varchar) as key from (select distinct {c} from ({HEADS}) where {c} is not null) where {c} not in ({parents})" for n, c, parents in CHECKS),
    *(f"select 'orphan {k}' as \"check\", finding_id as key from (select distinct finding_id, finding_type from ({CHILDREN})) where finding_type = '{k}' and finding_id not in (select finding_id from findings)" for k in ("price", "promotion", "news")),
    *(f"select '{k} without child' as \"check\", finding_id as key from (select distinct finding_id, finding_type from findings) where finding_type = '{k}' and finding_id not in (select finding_id from ({CHILDREN}) where finding_type = '{k}')" for k in ("price", "promotion", "news")),
]))
def q1(t):
    n = F.col("observation_id")
    head = t.findings.select("finding_id", "finding_type", F.when(n % 97 == 0, 100000 + F.col("competitor_id")).otherwise(F.col("competitor_id")).alias("competitor_id"), F.when(n % 89 == 0, -n).otherwise(F.expr("observation_id div 10")).alias("run_id"))
    child = t.findings.where(n % 79 != 0).select(F.concat(F.when(n % 83 == 0, "X").otherwise("F"), n).alias("finding_id"), "finding_type")
    of = lambda df, k: df.where(F.col("finding_type") == k)
    checks = [("competitor reference", head, t.competitors, "competitor_id"), ("run reference", head.where("run_id is not null"), t.runs, "run_id")]
    checks += [(f"orphan {k}", of(child, k), head, "finding_id") for k in ("price", "promotion", "news")]
    checks += [(f"{k} without child", of(head, k), of(child, k), "finding_id") for k in ("price", "promotion", "news")]
    return Q.missing_parents(checks)


@query("q2", """select 'unknown' as "check", 'status' as field, count(*) filter (status not in ('active', 'upcoming')) as n from campaigns union all select 'blank', 'status', count(*) filter (status is null) from campaigns
    union all select 'blank', 'end_date', count(*) filter (end_date is null) from campaigns union all select 'bad date', 'observed_date', count(*) filter (observed_date is null) from campaigns union all select 'bad date', 'campaign_name', count(*) from campaigns""")
def q2(t):
    return Q.field_checks(t.campaigns, {"status": ["active", "upcoming"]}, ["status", "end_date"], ["observed_date", "campaign_name"])


@query("q3", """select 'missing model' as issue, brand, count(*) filter (model_no = '') as n from canonical group by 2 union all select 'duplicate model', brand, count(*) filter (c > 1) from
    (select brand, count(*) over (partition by brand, model_no) as c from canonical where model_no <> '') group by 2 union all select 'to review', brand, count(*) filter (mapping_status = 'REVIEW') from canonical group by 2""")
def q3(t):
    c = t.canonical
    one = lambda name, df, n: df.groupBy("brand").agg(n.alias("n")).select(F.lit(name).alias("issue"), "brand", "n")
    dup = c.where("model_no <> ''").groupBy("brand", "model_no").agg(F.count("*").alias("c"))
    again = F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0))
    return G.union_all(one("missing model", c, F.count_if(F.col("model_no") == "")), one("duplicate model", dup, again), one("to review", c, F.count_if(F.col("mapping_status") == "REVIEW")))


@query("q4", "select count(*) as products, count(*) filter (model_no = '') as missing, count(*) filter (mapping_status = 'REVIEW') as review, case when count(*) filter (model_no = '') = 0 and count(*) filter (mapping_status = 'REVIEW') = 0 then 'PASS' else 'REVIEW' end as verdict from canonical")
def q4(t):
    missing, review = F.count_if(F.col("model_no") == ""), F.count_if(F.col("mapping_status") == "REVIEW")
    return t.canonical.agg(F.count("*").alias("products"), missing.alias("missing"), review.alias("review"), F.when((missing == 0) & (review == 0), "PASS").otherwise("REVIEW").alias("verdict"))


@query("q5", f"""select coalesce(a.signal_type, e.signal_type) as signal_type, coalesce(a.n, 0) as actual, coalesce(e.n, 0) as expected, case when e.n is null then 'UNSUPPORTED' when a.n is null then 'MISSING' when a.n = e.n then 'OK' else 'MISMATCH' end as state
    from (select signal_type, count(*) as n from ({N2} union all {N4}) group by 1) a full join (select 'BRAND_PRICE_TREND' as signal_type, cast(50 as bigint) as n union all select 'MULTI_COMPETITOR_CAMPAIGN', 1 union all select 'PRICE_CAMPAIGN_CONCURRENCY', 7) e on a.signal_type = e.signal_type""")
def q5(t):
    signals = G.brand_trends(movements(t)).unionByName(G.campaign_signals(t.campaigns.where("verification_status = 'VERIFIED'")))
    actual = signals.groupBy("signal_type").agg(F.count("*").alias("n"))
    expected = t.spark.createDataFrame([("BRAND_PRICE_TREND", 50), ("MULTI_COMPETITOR_CAMPAIGN", 1), ("PRICE_CAMPAIGN_CONCURRENCY", 7)], "signal_type string, n long")
    return Q.against_expectation(actual, expected, "signal_type")


@query("q6", "select competitor_id, identifier, first_seen_date, last_seen_date from catalogue where (model = '' and observations > 1) or identifier in ('7', '11', '13')")
def q6(t):
    return t.catalogue.where(((F.col("model") == "") & (F.col("observations") > 1)) | F.col("identifier").isin("7", "11", "13")).select("competitor_id", "identifier", "first_seen_date", "last_seen_date")


@query("q7", "select r.competitor_id, r.status, count(*) as runs, min(r.started_on) as first_run, max(r.started_on) as last_run from runs r where r.status <> 'completed' group by 1, 2")
def q7(t):
    return t.runs.where("status <> 'completed'").groupBy("competitor_id", "status").agg(F.count("*").alias("runs"), F.min("started_on").alias("first_run"), F.max("started_on").alias("last_run"))


@query("q8", "select brand, products, persistent, case when persistent > 0 then 'HISTORY_AVAILABLE' else 'INSUFFICIENT_HISTORY' end as history from summary")
def q8(t):
    return summary(t).select("brand", "products", "persistent", F.when(F.col("persistent") > 0, "HISTORY_AVAILABLE").otherwise("INSUFFICIENT_HISTORY").alias("history"))

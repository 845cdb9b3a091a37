"""Queries of joins, aggregations, windows, sorts, sets and de-duplication."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup as D
from ..operators import matching as M
from ..operators import news as N
from ..operators import pairing as A
from ..operators import prices as P
from ..operators.blocks import judged_pairs
from ..sources import keyed as K
from ..sources.tables import overwrite, scratch
from .bind import AS_OF, BASELINE, OWN_BRAND, VIEWS, half_up
from .q_catalogue import KNOWN, RANKED, titled
from .registry import query

#: SQL views of operator results that later queries build on.
VIEWS |= {
    "latest": """select competitor_id, upper(trim(brand)) as id_brand, upper(trim(model)) as id_model, upper(trim(product_name)) as id_product, observed_date,
        max({'o': observation_id, 'p': price_kes})['p'] as price_kes, count(*) as n_rows from prices
        group by 1, 2, 3, 4, 5""",
    "movements": """select competitor_id, id_brand, id_model, id_product, previous_date, observed_date, previous_price, price_kes as current_price,
        floor((price_kes - previous_price) * 100 + 0.5) / 100 as change,
        case when previous_price <> 0 then floor((price_kes - previous_price) / previous_price * 100 * 100 + 0.5) / 100 end as pct
        from (select *, lag(price_kes) over w as previous_price, lag(observed_date) over w as previous_date from latest
            window w as (partition by competitor_id, id_brand, id_model, id_product order by observed_date))
        where previous_price is not null and previous_price <> price_kes""",
}

# ---------------------------------------------------------------- J: joins


@query("j1", "select f.finding_id, p.model, p.price_kes, c.competitor_name from findings f join prices p on f.observation_id = p.observation_id and f.summary = p.product_name join competitors c on f.competitor_id = c.competitor_id")
def j1(t):
    f = t.findings.select("finding_id", "observation_id", "competitor_id", F.col("summary").alias("product_name"))
    j = f.join(t.prices.select("observation_id", "product_name", "model", "price_kes"), ["observation_id", "product_name"]).join(t.competitors, "competitor_id")
    return j.select("finding_id", "model", "price_kes", "competitor_name")


@query("j2", "select c.competitor_id, c.competitor_name, count(p.campaign_id) as campaigns from competitors c left join campaigns p on c.competitor_id = p.competitor_id group by all")
def j2(t):
    n = t.campaigns.groupBy("competitor_id").agg(F.count("*").alias("n"))
    return t.competitors.join(n, "competitor_id", "left").select("competitor_id", "competitor_name", F.coalesce("n", F.lit(0).cast("long")).alias("campaigns"))


@query("j3", "select distinct competitor_id from campaigns where competitor_id not in (select competitor_id from competitors)")
def j3(t):
    return t.campaigns.join(t.competitors, "competitor_id", "left_anti").select("competitor_id").distinct()


@query("j4", f"""select 'new' as state, count(*) as n from (select distinct model, price_kes, observed_date from prices where observed_date >= date '{AS_OF}') i
    where not exists (select 1 from prices s where s.observed_date < date '{AS_OF}' and s.model = i.model and s.price_kes = i.price_kes)
    union all select 'skipped', count(*) from (select distinct model, price_kes, observed_date from prices where observed_date >= date '{AS_OF}') i
    where exists (select 1 from prices s where s.observed_date < date '{AS_OF}' and s.model = i.model and s.price_kes = i.price_kes)""")
def j4(t):
    stored = t.prices.where(F.col("observed_date") < AS_OF).select("model", "price_kes").distinct()
    incoming = t.prices.where(F.col("observed_date") >= AS_OF).select("model", "price_kes", "observed_date").distinct()
    count = lambda how, name: incoming.join(stored, ["model", "price_kes"], how).agg(F.lit(name).alias("state"), F.count("*").alias("n"))
    return count("left_anti", "new").unionByName(count("left_semi", "skipped"))


J5 = """select m.competitor_id, m.id_brand, m.id_model, m.id_product, m.previous_date, m.observed_date, m.pct, c.campaign_id, c.competitor_id as campaign_competitor, c.campaign_name
    from movements m join (select * from campaigns where verification_status = 'VERIFIED') c
    on not (c.start_date is null and c.end_date is null) and ((coalesce(m.previous_date >= c.start_date, true) and coalesce(m.previous_date <= c.end_date, true))
    or (coalesce(m.observed_date >= c.start_date, true) and coalesce(m.observed_date <= c.end_date, true)))"""


def overlaps(t):
    pairs = P.overlapping_campaigns(P.detect_movements(t.prices), t.campaigns.where("verification_status = 'VERIFIED'"))
    return pairs.select(*P.IDENTITY, "previous_date", "observed_date", "pct", "campaign_id", "campaign_competitor", "campaign_name")


@query("j5", J5)
def j5(t):
    return overlaps(t)


@query("j6", """select p.observation_id, p.price_kes, b.previous_price from prices p left join (select model, competitor_id, observed_date, lag(price_kes) over (partition by model, competitor_id order by observed_date) as previous_price
    from (select model, competitor_id, observed_date, max({'o': observation_id, 'p': price_kes})['p'] as price_kes from prices group by all)) b using (model, competitor_id, observed_date)""")
def j6(t):
    return P.previous_price(t.prices, ["model", "competitor_id"]).select("observation_id", "price_kes", "previous_price")


@query("j7", """select a.product_id as own_id, b.product_id as other_id from canonical a join canonical b on a.category = b.category and a.sub_category = b.sub_category
    where a.brand = 'Brand#1' and b.brand <> 'Brand#1'""")
def j7(t):
    ids = t.canonical.select("category", "sub_category", "brand", "product_id")
    return M.block_pairs(ids, OWN_BRAND).select(F.col("own.product_id").alias("own_id"), F.col("other.product_id").alias("other_id"))


@query("j8", """select p.observation_id, coalesce(m.product_id, n.product_id) as product_id from prices p
    left join (select upper(model_no) as k, min(product_id) as product_id from canonical where model_no <> '' group by 1) m on upper('M' || p.model) = m.k
    left join (select lower(item_name) as k, min(product_id) as product_id from canonical group by 1) n on lower(p.product_name) = n.k""")
def j8(t):
    c = t.canonical
    by_model = c.where("model_no <> ''").groupBy(F.upper("model_no").alias("model_key")).agg(F.min("product_id").alias("by_model"))
    by_name = c.groupBy(F.lower("item_name").alias("name_key")).agg(F.min("product_id").alias("by_name"))
    p = t.prices.select("observation_id", F.upper(F.concat(F.lit("M"), "model")).alias("model_key"), F.lower("product_name").alias("name_key"))
    return p.join(by_model, "model_key", "left").join(by_name, "name_key", "left").select("observation_id", F.coalesce("by_model", "by_name").alias("product_id"))


@query("j9", """select p.page_id, coalesce(s.competitor_id, u.competitor_id) as competitor_id from pages p left join competitors s on p.page_id = s.competitor_id
    left join competitors u on 'https://shop' || (p.page_id % 50) || '.example.net/x' = u.secondary_url""")
def j9(t):
    c = t.competitors
    by_id = c.select(F.col("competitor_id").alias("page_id"), F.col("competitor_id").alias("a"))
    by_url = c.where("secondary_url is not null").select(F.col("secondary_url").alias("u"), F.col("competitor_id").alias("b"))
    p = t.raw("pages").select("page_id", F.concat(F.lit("https://shop"), F.col("page_id") % 50, F.lit(".example.net/x")).alias("u"))
    return p.join(by_id, "page_id", "left").join(by_url, "u", "left").select("page_id", F.coalesce("a", "b").alias("competitor_id"))


RESOLVE = """select a.observation_id, coalesce(n.competitor_id, b.competitor_id) as competitor_id from
    (select observation_id, case when observation_id % 2 = 0 then 'Supplier#' || lpad(cast(competitor_id as varchar), 9, '0') end as name, case competitor_id % 3 when 0 then 'NATION_7' when 1 then 'NATION_12' else 'NATION_20' end as brand from social) a
    left join (select lower(competitor_name) as k, min(competitor_id) as competitor_id from competitors group by 1 having count(distinct competitor_id) = 1) n on lower(a.name) = n.k
    left join (select lower(brand_name) as k, min(competitor_id) as competitor_id from competitors group by 1 having count(distinct competitor_id) = 1) b on lower(a.brand) = b.k"""


@query("j10", RESOLVE)
def j10(t):
    from ..operators.signals import resolve_unique

    brand = F.expr("case competitor_id % 3 when 0 then 'NATION_7' when 1 then 'NATION_12' else 'NATION_20' end")
    name = F.when(F.col("observation_id") % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad(F.col("competitor_id").cast("string"), 9, "0")))
    return resolve_unique(t.social.select("observation_id", name.alias("name"), brand.alias("brand")), t.competitors).select("observation_id", "competitor_id")


@query("j11", """select n_name as source_name, min(competitor_id) as competitor_id from (select n_name, c.competitor_id from nation join competitors c on c.brand_name = n_name
    union all select s_name, c.competitor_id from supplier join competitors c on c.competitor_name = s_name) group by 1""")
def j11(t):
    sources = t.raw("nation").select(F.col("n_name").alias("source_name")).unionByName(t.raw("supplier").select(F.col("s_name").alias("source_name")))
    key = lambda c: t.competitors.select(F.col(c).alias("source_name"), "competitor_id")
    both = key("competitor_name").unionByName(key("brand_name"))
    return sources.distinct().join(both, "source_name").groupBy("source_name").agg(F.min("competitor_id").alias("competitor_id"))


J12 = r"""list_filter(['license', 'the', 'token', 'die', 'les'], lambda x: regexp_matches(lower(coalesce(body, '')), '(^|[^a-z0-9])' || x || '([^a-z0-9]|$)'))"""


@query("j12", f"""select news_id, coalesce(list_filter(named, lambda x: contains(lower(headline), x))[1], named[1]) as entity
    from (select news_id, headline, list_filter({J12}, lambda x: x in ('the', 'token', 'les', 'die')) as named from news)""")
def j12(t):
    entities = N.terms_in(F.coalesce("body", F.lit("")), ["license", "the", "token", "die", "les"])
    rows = t.news.select("news_id", "headline", entities.alias("entities"))
    return rows.select("news_id", N.attribute(F.col("entities"), F.col("headline"), ["the", "token", "les", "die"]).alias("entity"))


@query("j13", """select q.conv_id, q.turn, list_sort(list(distinct c.s_suppkey)) as competitor_ids from questions q join (select s_suppkey, lower(s_name) as alias from supplier
    union all select s_suppkey, lower(n_name) from supplier join nation on s_nationkey = n_nationkey) c on c.alias = case q.conv_id % 3 when 0 then 'nation_7' when 1 then 'supplier#000000007' else 'nowhere' end group by all""")
def j13(t):
    from ..operators.reports import resolve_scope

    alias = F.expr("case conv_id % 3 when 0 then 'Nation_7' when 1 then 'Supplier#000000007' else 'nowhere' end")
    return resolve_scope(t.questions.select("conv_id", "turn", alias.alias("alias")), t.competitors).select("conv_id", "turn", "competitor_ids")


@query("j14", """select q.conv_id, q.turn, count(distinct c.alias) as mentioned from (select conv_id, turn, lower(coalesce(question, '')) || ' nation_7 and nation_12' as q from questions where conv_id % 2 = 0
    union all select conv_id, turn, lower(coalesce(question, '')) from questions where conv_id % 2 <> 0) q join (select distinct lower(n_name) as alias from nation) c on regexp_matches(q.q, '(^|[^a-z0-9#&_])' || c.alias || '([^a-z0-9#&_]|$)') group by all""")
def j14(t):
    from ..operators.reports import mentions

    q = F.concat(F.lower(F.coalesce("question", F.lit(""))), F.when(F.col("conv_id") % 2 == 0, " nation_7 and nation_12").otherwise(""))
    return mentions(t.questions.select("conv_id", "turn", q.alias("q")), "q", t.raw("nation").select(F.lower("n_name").alias("alias")).distinct()).groupBy("conv_id", "turn").agg(F.count_distinct("alias").alias("mentioned"))


@query("j15", """select c.campaign_id, s.observation_id, s.post_url, p.likes from campaigns c join (select campaign_id, campaign_id % 10000 as observation_id from campaigns) l on c.campaign_id = l.campaign_id
    join social s on s.observation_id = l.observation_id join (select event_id, likes from social) p on p.event_id = s.observation_id""")
def j15(t):
    links = t.campaigns.select("campaign_id", (F.col("campaign_id") % 10000).alias("observation_id"))
    return t.campaigns.select("campaign_id").join(links, "campaign_id").join(t.social, "observation_id").select("campaign_id", "observation_id", "post_url", "likes")


# ---------------------------------------------------------------- A: aggregations

COVER = "count(*) as observations, count(distinct observed_date) as days, count(distinct model) as models, min(observed_date) as first_date, max(observed_date) as last_date"


def cover():
    return [F.count("*").alias("observations"), F.count_distinct("observed_date").alias("days"), F.count_distinct("model").alias("models"),
            F.min("observed_date").alias("first_date"), F.max("observed_date").alias("last_date")]


@query("a1", f"select competitor_id, brand, {COVER} from prices group by all")
def a1(t):
    return t.prices.groupBy("competitor_id", "brand").agg(*cover())


@query("a2", """select competitor_id, count(*) as campaigns, count(distinct case when status = 'active' then campaign_id end) as active, count(distinct case when status = 'upcoming' then campaign_id end) as upcoming,
    count(distinct campaign_type) as types, count(distinct category) as categories, min(start_date) as first_start, max(end_date) as last_end from campaigns group by 1""")
def a2(t):
    state = lambda s: F.count_distinct(F.when(F.col("status") == s, F.col("campaign_id"))).alias(s)
    return t.campaigns.groupBy("competitor_id").agg(F.count("*").alias("campaigns"), state("active"), state("upcoming"), F.count_distinct("campaign_type").alias("types"),
        F.count_distinct("category").alias("categories"), F.min("start_date").alias("first_start"), F.max("end_date").alias("last_end"))


SOCIAL_COVERAGE = "count(*) as posts, count(distinct platform) as platforms, count(distinct account_name) as accounts, cast(sum(likes) as bigint) as likes, max(published_date) as last_post"


@query("a3", f"select competitor_id, {SOCIAL_COVERAGE} from social group by competitor_id union all select null, {SOCIAL_COVERAGE} from social")
def a3(t):
    """Coverage by competitor, and that of all posts under a null competitor."""
    coverage = [F.count("*").alias("posts"), F.count_distinct("platform").alias("platforms"), F.count_distinct("account_name").alias("accounts"), F.sum("likes").alias("likes"), F.max("published_date").alias("last_post")]
    return t.social.groupBy("competitor_id").agg(*coverage).unionByName(t.social.agg(*coverage).withColumn("competitor_id", F.lit(None).cast("long")))


@query("a4", """select source, count(*) as products, count(distinct identifier) as identifiers, count(distinct category) as categories, min(first_seen) as first_seen, max(last_seen) as last_seen from (
    select brand as source, identifier, category, first_seen_date as first_seen, last_seen_date as last_seen from catalogue union all select 'canonical', model_no, category, null, null from canonical) group by 1""")
def a4(t):
    a = t.catalogue.select(F.col("brand").alias("source"), "identifier", "category", F.col("first_seen_date").alias("first_seen"), F.col("last_seen_date").alias("last_seen"))
    none = F.lit(None).cast("date")
    b = t.canonical.select(F.lit("canonical").alias("source"), F.col("model_no").alias("identifier"), "category", none.alias("first_seen"), none.alias("last_seen"))
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("products"), F.count_distinct("identifier").alias("identifiers"), F.count_distinct("category").alias("categories"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


@query("a5", f"select brand, count(*) as products, count(*) filter (first_seen_date < last_seen_date) as persistent, count(*) filter (first_seen_date > date '{BASELINE}') as post_baseline from catalogue group by 1")
def a5(t):
    return t.catalogue.groupBy("brand").agg(F.count("*").alias("products"), F.count_if(F.col("first_seen_date") < F.col("last_seen_date")).alias("persistent"), F.count_if(F.col("first_seen_date") > BASELINE).alias("post_baseline"))


@query("a6", "select brand, first_seen_date, count(*) as products from catalogue group by all")
def a6(t):
    return t.catalogue.groupBy("brand", "first_seen_date").agg(F.count("*").alias("products"))


@query("a7", "select scan_week, finding_type, case when grouping(brand) = 1 then 'ALL' else brand end as brand, count(*) as findings from findings group by grouping sets ((scan_week, finding_type), (scan_week, finding_type, brand))")
def a7(t):
    f = t.findings.rollup(F.struct("scan_week", "finding_type").alias("k"), "brand").agg(F.count("*").alias("findings")).where("k is not null")
    return f.select("k.scan_week", "k.finding_type", F.coalesce("brand", F.lit("ALL")).alias("brand"), "findings")


@query("a8", """select source_url, count(*) as findings, count(distinct brand) as brands, max(observed_date) as latest, count(*) filter (verification_status = 'VERIFIED') as verified, count(*) filter (confidence = 'HIGH') as high from findings group by 1""")
def a8(t):
    return t.findings.groupBy("source_url").agg(F.count("*").alias("findings"), F.count_distinct("brand").alias("brands"), F.max("observed_date").alias("latest"),
        F.count_if(F.col("verification_status") == "VERIFIED").alias("verified"), F.count_if(F.col("confidence") == "HIGH").alias("high"))


LAST_WEEK = "(select max(scan_week) from findings)"
A9 = f"""select (select count(*) from findings where scan_week = {LAST_WEEK}) as week_findings, (select count(*) from findings where scan_week = {LAST_WEEK} and finding_type = 'price') as week_prices,
    (select count(*) from findings where scan_week = {LAST_WEEK} and finding_type = 'promotion') as week_promotions, (select count(*) from findings where scan_week = {LAST_WEEK} and finding_type = 'news') as week_news,
    (select count(*) from competitors) as competitors, (select count(*) from prices) as price_observations, (select count(*) from findings where finding_type = 'promotion') as promotion_observations,
    (select count(*) from findings where finding_type = 'news') as news_observations,
    (select count(*) from campaigns where start_date is not null and start_date <= date '{AS_OF}' and (end_date is null or end_date >= date '{AS_OF}') and status <> 'ended') as active_campaigns,
    (select count(*) from campaigns where start_date is not null and start_date > date '{AS_OF}' and status = 'upcoming') as upcoming_campaigns, (select count(*) from social) as social_observations,
    (select count(*) from movements) + (select count(*) from campaigns where verification_status = 'VERIFIED') as market_trends,
    (select count(*) from movements) + (select count(*) from campaigns where verification_status = 'VERIFIED' and status in ('active', 'upcoming')) as open_alerts,
    (select count(distinct competitor_id) * 2 from prices) as comparisons, (select count(*) from catalogue where brand = 'Brand#1') as products_1, (select count(*) from catalogue where brand = 'Brand#2') as products_2,
    (select count(*) from catalogue where brand = 'Brand#3') as products_3"""


@query("a9", A9)
def a9(t):
    n = lambda name: F.count("*").alias(name)
    verified = F.col("verification_status") == "VERIFIED"
    live = verified & F.col("status").isin("active", "upcoming")
    kinds = t.findings.groupBy("scan_week", "finding_type").agg(n("n"))
    week = kinds.agg(F.max("scan_week").alias("last"))
    of = lambda k: F.col("finding_type") == k
    total = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(name)
    now = F.col("scan_week") == F.col("last")
    findings = kinds.crossJoin(F.broadcast(week)).agg(  # one row
        total(now, "week_findings"), total(now & of("price"), "week_prices"), total(now & of("promotion"), "week_promotions"), total(now & of("news"), "week_news"),
        total(of("promotion"), "promotion_observations"), total(of("news"), "news_observations"),
    )
    start, end, day = F.col("start_date"), F.col("end_date"), F.lit(AS_OF).cast("date")
    active = (start <= day) & (end.isNull() | (end >= day)) & (F.col("status") != "ended")
    campaigns = t.campaigns.agg(F.count_if(active).alias("active_campaigns"), F.count_if((start > day) & (F.col("status") == "upcoming")).alias("upcoming_campaigns"), F.count_if(verified).alias("v"), F.count_if(live).alias("a"))
    moved = P.detect_movements(t.prices).agg(n("m"))
    brands = t.catalogue.agg(*(F.count_if(F.col("brand") == f"Brand#{i}").alias(f"products_{i}") for i in (1, 2, 3)))
    prices = t.prices.agg(n("price_observations"), (F.count_distinct("competitor_id") * 2).alias("comparisons"))
    out = findings
    for part in (t.competitors.agg(n("competitors")), prices, campaigns, t.social.agg(n("social_observations")), moved, brands):  # one row each
        out = out.crossJoin(F.broadcast(part))
    return out.withColumns({"market_trends": F.col("m") + F.col("v"), "open_alerts": F.col("m") + F.col("a")}).drop("m", "v", "a")


@query("a10", """select 'platform' as field, platform as value, count(*) as n from social group by 2 union all select 'type', social_type, count(*) from social group by 2
    union all select 'status', coalesce(status, 'UNSPECIFIED'), count(*) from campaigns group by 2""")
def a10(t):
    def dist(df, field, c):
        return df.groupBy(F.coalesce(F.col(c), F.lit("UNSPECIFIED")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(field).alias("field"), "value", "n")

    return dist(t.social, "platform", "platform").unionByName(dist(t.social, "type", "social_type")).unionByName(dist(t.campaigns, "status", "status"))


PIVOT = """select category, count(*) filter (brand = 'Brand#1') as own, count(*) filter (brand = 'Brand#2') as rival_a, count(*) filter (brand = 'Brand#3') as rival_b, count(*) filter (brand in ('Brand#1', 'Brand#2', 'Brand#3')) as total from canonical group by 1"""
PIVOT_BRANDS = {"Brand#1": "own", "Brand#2": "rival_a", "Brand#3": "rival_b"}


@query("a11", PIVOT)
def a11(t):
    from ..operators.catalogue import coverage_matrix

    return coverage_matrix(t.canonical, ["category"], PIVOT_BRANDS)


@query("a12", "select sub_category, array_to_string(list_sort(list(distinct brand)), ', ') as brands, count(distinct brand) as n_brands from canonical group by 1")
def a12(t):
    s = F.array_sort(F.collect_set("brand"))
    return t.canonical.groupBy("sub_category").agg(F.array_join(s, ", ").alias("brands"), F.count_distinct("brand").alias("n_brands"))


@query("a13", """select brand, count(*) filter (model_no <> '') as available, count(*) filter (model_no = '') as missing, count(distinct case when model_no <> '' then model_no end) as unique_models,
    floor(count(*) filter (model_no <> '') / count(*) * 100 * 10 + 0.5) / 10 as pct from canonical group by 1""")
def a13(t):
    from ..operators.catalogue import identifier_coverage

    return identifier_coverage(t.canonical)


@query("a14", """select brand, count(*) as products, count(*) filter (mapping_status = 'MAPPED') as mapped, count(*) filter (mapping_status = 'REVIEW') as review, count(*) filter (mapping_confidence = 'HIGH') as high,
    count(*) filter (mapping_confidence = 'MEDIUM') as medium, count(*) filter (mapping_confidence = 'LOW') as low, count(*) filter (product_scope = 'core') as core from canonical group by 1""")
def a14(t):
    from ..operators.catalogue import validation_summary

    return validation_summary(t.canonical)


@query("a15", """select category, count(*) as sub_categories, cast(sum(own) as bigint) as own, cast(sum(rival) as bigint) as rival, count(*) filter (own > 0 and rival > 0) as shared, count(*) filter (own = 0 and rival > 0) as gaps from
    (select category, sub_category, count(*) filter (brand = 'Brand#1') as own, count(*) filter (brand <> 'Brand#1') as rival from canonical group by 1, 2) group by 1""")
def a15(t):
    from ..operators.catalogue import gap_rollup, own_rival

    return gap_rollup(own_rival(t.canonical, "Brand#1"))


@query("a16", "select competitor_id, model, observed_date, count(*) as n, string_agg(cast(observation_id as varchar), ',' order by observation_id) as members from prices group by 1, 2, 3 having count(*) > 1")
def a16(t):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("observation_id")), lambda x: x.cast("string")), ",")
    return t.prices.groupBy("competitor_id", "model", "observed_date").agg(F.count("*").alias("n"), ids.alias("members")).where("n > 1")


@query("a17", """select r.run_id, r.declared, coalesce(a.n, 0) as actual, case when r.declared = coalesce(a.n, 0) then 'OK' else 'MISMATCH' end as verdict from runs r
    left join (select l_orderkey as run_id, count(*) as n from lineitem group by 1) a on r.run_id = a.run_id""")
def a17(t):
    actual = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return t.runs.join(actual, "run_id", "left").select("run_id", "declared", n.alias("actual"), F.when(F.col("declared") == n, "OK").otherwise("MISMATCH").alias("verdict"))


@query("a18", """select count(*) as products, count(*) filter (size > 10) as populated, case when count(*) = 0 then null else floor(count(*) filter (size > 10) / count(*) * 100 * 10 + 0.5) / 10 end as pct,
    case when count(*) filter (size > 10) = 0 then 'INSUFFICIENT_HISTORY' else 'AVAILABLE' end as status from canonical""")
def a18(t):
    n, m = F.count("*"), F.count_if(F.col("size") > 10)
    return t.canonical.agg(n.alias("products"), m.alias("populated"), F.when(n > 0, half_up(m / n * 100, 1)).alias("pct"), F.when(m == 0, "INSUFFICIENT_HISTORY").otherwise("AVAILABLE").alias("status"))


@query("a19", "select competitor_id, model, count(distinct price_kes) as prices from prices group by 1, 2 having count(distinct price_kes) > 1")
def a19(t):
    return t.prices.groupBy("competitor_id", "model").agg(F.count_distinct("price_kes").alias("prices")).where("prices > 1")


@query("a20", """select category, n from (select category, count(*) as n, min(campaign_id) as first from campaigns group by 1) order by n desc, first limit 1""")
def a20(t):
    n = t.campaigns.groupBy("category").agg(F.count("*").alias("n"), F.min("campaign_id").alias("first"))
    return n.orderBy(F.desc("n"), "first").limit(1).select("category", "n")


EVIDENCE = """select competitor_id, 'price' as evidence_type, count(*) as n from prices group by 1 union all select competitor_id, 'campaign', count(*) from campaigns group by 1
    union all select competitor_id, 'social', count(*) from social group by 1 union all select competitor_id, 'catalogue', count(*) from catalogue group by 1"""


@query("a22", """select competitor_id, 'active_campaigns' as evidence_type, count(*) as n from campaigns where status = 'active' group by 1 union all select competitor_id, 'upcoming_campaigns', count(*) from campaigns where status = 'upcoming' group by 1
    union all select competitor_id, 'alerts', count(*) from (select competitor_id from movements union all select competitor_id from campaigns where verification_status = 'VERIFIED' and status in ('active', 'upcoming')) group by 1
    union all select competitor_id, 'social', count(*) from social group by 1 union all select competitor_id, 'trends', count(*) from movements group by 1""")
def a22(t):
    from ..operators.reports import evidence_counts

    c, moved = t.campaigns, P.detect_movements(t.prices).select("competitor_id")
    alerts = moved.unionByName(c.where("verification_status = 'VERIFIED' and status in ('active', 'upcoming')").select("competitor_id"))
    return evidence_counts({"active_campaigns": c.where("status = 'active'"), "upcoming_campaigns": c.where("status = 'upcoming'"), "alerts": alerts, "social": t.social, "trends": moved})


@query("a24", "select model, count(*) as observations, min(observed_date) as first_date, max(observed_date) as last_date from prices group by 1 having count(*) > 1")
def a24(t):
    return t.prices.groupBy("model").agg(F.count("*").alias("observations"), F.min("observed_date").alias("first_date"), F.max("observed_date").alias("last_date")).where("observations > 1")


@query("a25", """select 'price' as evidence, count(*) as n, count(distinct observed_date) as days, count(distinct competitor_id) as competitors, min(observed_date) as first_date, max(observed_date) as last_date from prices
    union all select 'campaign', count(*), count(distinct observed_date), count(distinct competitor_id), min(observed_date), max(observed_date) from campaigns
    union all select 'social', count(*), count(distinct observed_date), count(distinct competitor_id), min(observed_date), max(observed_date) from social
    union all select 'catalogue ' || brand, count(*), null, null, min(first_seen_date), max(last_seen_date) from catalogue where brand in ('Brand#1', 'Brand#2', 'Brand#3') group by brand""")
def a25(t):
    def one(name, df):
        return df.agg(F.lit(name).alias("evidence"), F.count("*").alias("n"), F.count_distinct("observed_date").alias("days"), F.count_distinct("competitor_id").alias("competitors"),
                      F.min("observed_date").alias("first_date"), F.max("observed_date").alias("last_date"))

    brands = t.catalogue.where(F.col("brand").isin("Brand#1", "Brand#2", "Brand#3")).groupBy(F.concat(F.lit("catalogue "), "brand").alias("evidence"))
    dates = F.min("first_seen_date").alias("first_date"), F.max("last_seen_date").alias("last_date")
    products = brands.agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("days"), F.lit(None).cast("long").alias("competitors"), *dates)
    return one("price", t.prices).unionByName(one("campaign", t.campaigns)).unionByName(one("social", t.social)).unionByName(products)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("a26", " union all ".join(f"select '{x}' as table_name, count(*) as n from {x}" for x in TABLES))
def a26(t):
    out = None
    for x in TABLES:
        one = t.raw(x).agg(F.lit(x).alias("table_name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a27", "select brand, category, count(*) as n from prices group by all")
def a27(t):
    return t.prices.groupBy("brand", "category").agg(F.count("*").alias("n"))


@query("a28", """select dimension, value, count(*) as movements, count(*) filter (change > 0) as rises, count(*) filter (change < 0) as falls from (select 'brand' as dimension, id_brand as value, change from movements
    union all select 'category', p_type, change from movements join part on id_model = cast(p_partkey as varchar)) group by 1, 2 having count(*) >= case dimension when 'category' then 2 else 1 end""")
def a28(t):
    return P.movement_counts(P.detect_movements(t.prices, ("category",)), {"brand": "id_brand", "category": "category"}, {"category": 2})


# ---------------------------------------------------------------- W: windows


@query("w1", "select * from movements")
def w1(t):
    return P.detect_movements(t.prices)


@query("w2", "select competitor_id, id_brand, id_model, id_product, count(*) as ambiguous_days from latest where n_rows > 1 group by 1, 2, 3, 4")
def w2(t):
    return P.ambiguous_identities(t.prices)


@query("w3", "select competitor_id, id_brand, id_model, id_product, observed_date, price_kes from latest")
def w3(t):
    return P.latest_per_day(t.prices).drop("observation_id", "n_rows")


@query("w4")
def w4(t):
    return t.news.select("news_id", T.drop_repeated_tail("body").alias("body"))


@query("w5", """select post_url, observed_date, likes, views, likes - lag(likes) over (partition by post_url order by observed_date) as likes_growth from
    (select post_url, observed_date, arg_max(likes, observation_id) as likes, arg_max(views, observation_id) as views from social group by 1, 2)""")
def w5(t):
    return P.engagement_growth(t.social)


@query("w6", f"select own_id, other_id, match_level from ({RANKED}) where rn = 1 and match_level <> 'NO_DEFENSIBLE_MATCH'")
def w6(t):
    return A.best_matches(titled(t), OWN_BRAND, KNOWN).select("own_id", F.col("best_id").alias("other_id"), F.col("best_level").alias("match_level"))


@query("w7", "select model, min(observation_id) as first_observation from prices group by 1")
def w7(t):
    return P.first_per_key(t.prices, ["model"], ["observation_id"]).select("model", F.col("observation_id").alias("first_observation"))


@query("w8", "select max(run_id) as run_id, arg_max(scan_week, run_id) as scan_week from runs where status = 'completed'")
def w8(t):
    return t.runs.where("status = 'completed'").agg(F.max("run_id").alias("run_id"), F.max_by("scan_week", "run_id").alias("scan_week"))


# ---------------------------------------------------------------- T: sorts and limits


@query("t1", "select observation_id, platform, published_date from social order by published_date desc, observation_id desc limit 150")
def t1(t):
    return t.social.orderBy(F.desc("published_date"), F.desc("observation_id")).limit(150).select("observation_id", "platform", "published_date")


@query("t2", "select campaign_id, confidence, status, cast(row_number() over (order by case confidence when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end, case status when 'active' then 0 when 'upcoming' then 1 else 2 end, campaign_id) as integer) as place from campaigns order by place limit 100")
def t2(t):
    rank = F.expr("case confidence when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end")
    state = F.expr("case status when 'active' then 0 when 'upcoming' then 1 else 2 end")
    top = t.campaigns.orderBy(rank, state, "campaign_id").limit(100)
    return top.withColumn("place", F.row_number().over(W.orderBy(rank, state, "campaign_id"))).select("campaign_id", "confidence", "status", "place")


@query("t3", "select campaign_id, start_date, end_date from campaigns order by start_date desc nulls last, end_date asc nulls last, campaign_id limit 200")
def t3(t):
    return t.campaigns.orderBy(F.desc_nulls_last("start_date"), F.asc_nulls_last("end_date"), "campaign_id").limit(200).select("campaign_id", "start_date", "end_date")


@query("t4", "select category, sub_category, own, rival from (select category, sub_category, count(*) filter (brand = 'Brand#1') as own, count(*) filter (brand <> 'Brand#1') as rival from canonical group by 1, 2) order by category, rival desc, sub_category limit 30")
def t4(t):
    from ..operators.catalogue import own_rival

    return own_rival(t.canonical, "Brand#1").orderBy("category", F.desc("rival"), "sub_category").limit(30).select("category", "sub_category", "own", "rival")


@query("t5", "select observation_id, score from (select observation_id, likes * 2 + case social_type when 'purchase' then 50 when 'click' then 20 else 0 end as score, coalesce(views, 0) as v from social) order by score desc, v desc, observation_id limit 80")
def t5(t):
    score = F.expr("likes * 2 + case social_type when 'purchase' then 50 when 'click' then 20 else 0 end")
    return t.social.withColumn("score", score).orderBy(F.desc("score"), F.desc(F.coalesce("views", F.lit(0))), "observation_id").limit(80).select("observation_id", "score")


@query("t6", "select news_id, published_date from news where scope_status <> 'OUT_OF_SCOPE' order by published_date desc, news_id desc limit 10")
def t6(t):
    return t.news.where("scope_status <> 'OUT_OF_SCOPE'").orderBy(F.desc("published_date"), F.desc("news_id")).limit(10).select("news_id", "published_date")


@query("t7", "select platform, observation_id, rank from (select platform, observation_id, cast(row_number() over (partition by platform order by published_date desc, observation_id desc) as integer) as rank from social) where rank <= 20")
def t7(t):
    return P.top_per_group(t.social, ["platform"], [F.desc("published_date"), F.desc("observation_id")], 20).select("platform", "observation_id", "rank")


# ---------------------------------------------------------------- U: sets


@query("u1", "select brand as source, count(*) as n from catalogue group by 1 union all select 'canonical ' || brand, count(*) from canonical group by 1")
def u1(t):
    a = t.catalogue.groupBy(F.col("brand").alias("source")).agg(F.count("*").alias("n"))
    return a.unionByName(t.canonical.groupBy(F.concat(F.lit("canonical "), "brand").alias("source")).agg(F.count("*").alias("n")))


@query("u2", "select post_url from (select distinct post_url from social where platform = 'x' union select 'https://social.example.com/' || (news_id % 700) from news) s where post_url not in (select post_url from social where platform = 'facebook')")
def u2(t):
    ids = t.social.where("platform = 'x'").select("post_url").union(t.news.select(F.concat(F.lit("https://social.example.com/"), F.col("news_id") % 700))).distinct()
    return ids.join(t.social.where("platform = 'facebook'").select("post_url"), "post_url", "left_anti")


@query("u3", "select 'a' as tag, brand, item_name, null as model_no from canonical where brand = 'Brand#1' union all select 'b', brand, item_name, model_no from canonical where brand = 'Brand#2'")
def u3(t):
    a = t.canonical.where("brand = 'Brand#1'").select(F.lit("a").alias("tag"), "brand", "item_name")
    b = t.canonical.where("brand = 'Brand#2'").select(F.lit("b").alias("tag"), "brand", "item_name", "model_no")
    return a.unionByName(b, allowMissingColumns=True)


@query("u4", "select distinct category from canonical where category not in ('STANDARD', 'SMALL', 'PROMO')")
def u4(t):
    expected = t.spark.createDataFrame([("STANDARD",), ("SMALL",), ("PROMO",)], "category string")
    return t.canonical.select("category").distinct().join(expected, "category", "left_anti")


TOKENS = "list_distinct(list_filter(string_split(lower({}), ' '), lambda t: length(t) >= 3 and t not in ('the', 'and', 'new', 'red', 'rod')))"


@query("u5", f"""select own_id, other_id, floor(case when len(x) > 0 and len(y) > 0 then len(list_intersect(x, y)) / len(list_distinct(x || y)) else 0 end * 1000 + 0.5) / 1000 as jaccard
    from (select a.product_id as own_id, b.product_id as other_id, {TOKENS.format("a.item_name")} as x, {TOKENS.format("b.item_name")} as y
    from canonical a join canonical b on a.category = b.category and a.sub_category = b.sub_category where a.brand = 'Brand#1' and b.brand <> 'Brand#1')""")
def u5(t):
    tokens = F.array_sort(M.telling_tokens(F.col("item_name"), ["the", "and", "new", "red", "rod"])).alias("tokens")
    rows = t.canonical.select("category", "sub_category", "brand", "product_id", tokens)
    j = half_up(M.token_jaccard(F.col("own.tokens"), F.col("other.tokens")), 3)
    pairs = judged_pairs(rows, OWN_BRAND, ["product_id"], ["tokens"], lambda p: p.withColumn("jaccard", j), ["jaccard"])
    return pairs.select(F.col("own_product_id").alias("own_id"), F.col("other_product_id").alias("other_id"), "jaccard")


# ---------------------------------------------------------------- D: de-duplication


IDENTITIES = {
    "model_price_source": ["model", "price_kes", "source_url"],
    "source_price": ["source_url", "price_kes"],
    "model_source": ["model", "source_url"],
    "product_price": ["product_name", "price_kes"],
    "brand_model": ["brand", "model"],
    "source": ["source_url"],
}
SOLD = "(select *, 'https://m' || model || '.example.com/p' as source_url from prices)"


@query("d1", " union all ".join(f"select '{k}' as identity, count(*) as kept, cast(sum(first) as bigint) as first_ids from (select {', '.join(v)}, min(observation_id) as first from {SOLD} group by all)" for k, v in IDENTITIES.items()))
def d1(t):
    """Each collector's identity of a row within a batch; the first row stays."""
    rows = t.prices.withColumn("source_url", F.expr("'https://m' || model || '.example.com/p'"))
    out = None
    for name, keys in IDENTITIES.items():
        kept = D.keep_first(rows.select(*keys, "observation_id"), keys, "observation_id").agg(F.lit(name).alias("identity"), F.count("*").alias("kept"), F.sum("observation_id").alias("first_ids"))
        out = kept if out is None else out.unionByName(kept)
    return out


MERGE = """select case when model <> '' then '0:' || lower(model) else '1:' || lower(trim(product_name)) end as key, array_to_string(list_sort(list(distinct category)), ',') as categories,
    arg_min(nullif(model, ''), identifier) filter (model <> '') as model from
    catalogue group by 1"""


@query("d2", f"select key, categories, model from ({MERGE})")
def d2(t):
    c = t.catalogue.withColumns({"price": F.col("observations"), "is_sale": F.col("observations") > 2})
    return D.merge_categories(c, D.coalesced_key(c, "model", "product_name"), "identifier").select("key", "categories", "model")


OFFERS = """select observation_id, case when cast(model as integer) % 10 <> 0 then model end as sku, 'https://m' || cast(model as integer) // 3 || '.example.com/p' as url, product_name, price_kes as regular_price,
    case when discount > 0.05 then floor(price_kes * (1 - discount) * 100 + 0.5) / 100 end as sale_price, return_flag = 'R' as is_sale from prices"""


@query("d3", f"""select key, regular_price, sale_price, is_sale, sku from (select coalesce('sku:' || sku, 'url:' || url) as key, coalesce(arg_min(regular_price, observation_id) filter (sale_price is not null), arg_min(regular_price, observation_id)) as regular_price,
    arg_min(sale_price, observation_id) filter (sale_price is not null) as sale_price, bool_or(is_sale) as is_sale, max(sku) as sku from ({OFFERS}) group by 1)""")
def d3(t):
    model = F.col("model").cast("int")
    rows = t.prices.select(
        "observation_id", "product_name", F.when(model % 10 != 0, F.col("model")).alias("sku"), F.expr("'https://m' || (cast(model as int) div 3) || '.example.com/p'").alias("url"), F.col("price_kes").alias("regular_price"),
        F.when(F.col("discount") > 0.05, half_up(F.col("price_kes") * (1 - F.col("discount")))).alias("sale_price"), (F.col("return_flag") == "R").alias("is_sale"),
    )
    return D.merge_offers(rows, "observation_id").select("key", "regular_price", "sale_price", "is_sale", "sku")


@query("d4", "select competitor_id, model, min(observed_date) as first_seen_date, max(observed_date) as last_seen_date from prices group by 1, 2")
def d4(t):
    old, new = t.prices.where(F.col("observed_date") < AS_OF), t.prices.where(F.col("observed_date") >= AS_OF)
    keys = ["competitor_id", "model"]
    stored = old.groupBy(*keys).agg(F.min("observed_date").alias("first_seen_date"), F.max("observed_date").alias("last_seen_date"))
    path = scratch(t.spark, "d4")
    K.create(stored, path, keys)
    K.merge_into(path, new, keys, lambda a, b: D.upsert_seen(a, b, keys), stored)
    return K.read(t.spark, path, stored)


@query("d5", """select distinct competitor_id, category, start_date from campaigns i where campaign_id % 2 = 1 and not exists (select 1 from campaigns s where s.campaign_id % 2 = 0 and s.competitor_id = i.competitor_id and s.category = i.category and s.start_date is not distinct from i.start_date)""")
def d5(t):
    keys = ["competitor_id", "category", "start_date"]
    c = t.campaigns.select("campaign_id", *keys)
    return D.insert_if_absent(c.where("campaign_id % 2 = 0").select(*keys), c.where("campaign_id % 2 = 1").select(*keys), keys)


@query("d6", "select distinct brand, category, cast(null as varchar) as metric from canonical where brand <> 'Brand#1'")
def d6(t):
    keys = ["brand", "category", "metric"]
    rows = t.canonical.withColumn("metric", F.lit(None).cast("string")).select(*keys)
    return D.insert_if_absent(rows.where("brand = 'Brand#1'"), rows, keys)


@query("d7", """select campaign_name, start_date, max(case when k = 0 then campaign_id end) is not null as kept_id from (select campaign_name, start_date, campaign_id, campaign_id % 2 as k from campaigns) group by 1, 2""")
def d7(t):
    keys = ["campaign_name", "start_date"]
    old = t.campaigns.where("campaign_id % 2 = 0").groupBy(*keys).agg(F.max("campaign_id").alias("campaign_id"), F.max("offer_value").alias("offer_value"))
    new = t.campaigns.where("campaign_id % 2 = 1").groupBy(*keys).agg(F.max("offer_value").alias("offer_value"))
    rows = D.get_or_create(old, new, keys, "campaign_id", ["offer_value"])
    last = old.agg(F.max("campaign_id").alias("last"))
    return rows.crossJoin(F.broadcast(last)).select(*keys, (F.col("campaign_id") <= F.col("last")).alias("kept_id"))


@query("d8", """select case when news_id % 13 = 0 then sha1(lower(trim(regexp_replace(headline, '\\s+', ' ', 'g')))) else 'http://news.' || publisher || '.example.com/a/' || (news_id % 700) || '/?id=' || (news_id % 700) end as key, arg_max(news_id, length(coalesce(body, '')) * 1000000 - news_id) as news_id from news group by 1""")
def d8(t):
    url = F.when(F.col("news_id") % 13 != 0, F.col("source_url"))
    rows = t.news.withColumn("key", D.evidence_key(url, F.col("headline")))
    return D.longest_per_key(rows, [F.col("key")], "body", "news_id").select("key", "news_id")


@query("d9", """select post_url, observation_id, score from (select post_url, observation_id, likes as score, row_number() over (partition by post_url order by likes desc, observation_id) as rn from social where published_date >= date '2024-01-10') where rn = 1""")
def d9(t):
    fresh = t.social.where(F.col("published_date") >= "2024-01-10").withColumn("score", F.col("likes"))
    return P.first_per_key(fresh, ["post_url"], [F.desc("score"), "observation_id"]).select("post_url", "observation_id", "score")


@query("d10", "select lower(post_url) as url, lower(post_text) as evidence, min(observation_id) as observation_id from social group by 1, 2")
def d10(t):
    return t.social.groupBy(F.lower("post_url").alias("url"), F.lower("post_text").alias("evidence")).agg(F.min("observation_id").alias("observation_id"))


@query("d11", """select news_id from news i where news_id >= 500 and not exists (select 1 from news s where s.news_id < 500 and s.news_id = i.news_id)
    and not exists (select 1 from news s where s.news_id < 500 and s.publisher = i.publisher and s.news_id % 700 = i.news_id % 700)""")
def d11(t):
    rows = t.news.withColumn("identity", T.url_identity(F.col("source_url"))).select("news_id", "identity")
    stored, new = rows.where("news_id < 500"), rows.where("news_id >= 500")
    return new.join(stored.select("news_id"), "news_id", "left_anti").join(stored.select("identity"), "identity", "left_anti").select("news_id")


@query("d12", "select competitor_id, competitor_name from competitors where competitor_id % 2 = 0")
def d12(t):
    path = scratch(t.spark, "d12")
    overwrite(t.competitors.select("competitor_id", "competitor_name"), path)
    return overwrite(t.competitors.where("competitor_id % 2 = 0").select("competitor_id", "competitor_name"), path)


@query("d13", """select observation_id, case when discount > 0 then floor(price_kes * (1 - discount) * 100 + 0.5) / 100 else price_kes end as price_kes, case when discount > 0 then 'Regular KSh ' || cast(cast(floor(price_kes) as bigint) as varchar) end as note from prices""")
def d13(t):
    sale = F.when(F.col("discount") > 0, half_up(F.col("price_kes") * (1 - F.col("discount"))))
    note = F.when(F.col("discount") > 0, F.concat(F.lit("Regular KSh "), F.floor("price_kes").cast("string")))
    return t.prices.select("observation_id", F.coalesce(sale, F.col("price_kes")).alias("price_kes"), note.alias("note"))


@query("d14", "select competitor_id, case when competitor_id % 5 = 0 then 'https://new.example.com/' || competitor_id else official_url end as official_url from competitors")
def d14(t):
    u = t.competitors.where("competitor_id % 5 = 0").select("competitor_id", F.concat(F.lit("https://new.example.com/"), "competitor_id").alias("official_url"))
    return D.update_by_key(t.competitors, u, "competitor_id", ["official_url"]).select("competitor_id", "official_url")

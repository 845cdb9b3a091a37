"""Queries of sources, scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dictionary import found_in
from ..sources import pages as PG
from ..sources import tables as S
from .bind import AS_OF, BASELINE
from .registry import query

# ---------------------------------------------------------------- P: scalars


@query("p1", "select observation_id, upper(trim(regexp_replace('  ' || product_name || '   x', '\\s+', ' ', 'g'))) as identity from prices")
def p1(t):
    raw = F.concat(F.lit("  "), "product_name", F.lit("   x"))
    return t.prices.select("observation_id", T.identity_text(raw).alias("identity"))


@query("p2", "select news_id, trim(regexp_replace(coalesce(body, ''), '\\s+', ' ', 'g')) as clean from news")
def p2(t):
    return t.news.select("news_id", T.squeeze(F.col("body")).alias("clean"))


@query("p3", """select observation_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(post_text || ' ' || post_url), 'https?://\\S+', ' ', 'g'),
    '[^a-z0-9%&+\\- ]', ' ', 'g'), '\\s+', ' ', 'g')) as clean from social""")
def p3(t):
    return t.social.select("observation_id", T.search_text(F.concat_ws(" ", "post_text", "post_url")).alias("clean"))


@query("p4")
def p4(t):
    return t.news.select("news_id", T.clean_article("body").alias("clean"))


@query("p5", "select product_id, list_filter(string_split(trim(regexp_replace(translate(lower(item_name), '/,;|()-_.', '         '), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') as tokens from canonical")
def p5(t):
    return t.canonical.select("product_id", T.name_tokens(F.col("item_name")).alias("tokens"))


@query("p6", "select observation_id, try_cast(replace(regexp_extract('KSh ' || format('{:,}', cast(floor(price_kes) as bigint)) || '.50', '[0-9][0-9,]*(?:[.][0-9]+)?'), ',', '') as double) as price from prices")
def p6(t):
    raw = F.concat(F.lit("KSh "), F.format_number(F.floor("price_kes"), 0), F.lit(".50"))
    return t.prices.select("observation_id", T.parse_price(raw).alias("price"))


@query("p7", """select observation_id, list_distinct_ordered as prices from (select observation_id, case when a < 1000 and b < 1000 then [] when a < 1000 then [b] when a = b then [a] else [a, b] end as list_distinct_ordered
    from (select observation_id, price_kes, floor(price_kes) as a, floor(price_kes) + observation_id % 2 as b from prices))""")
def p7(t):
    a, b = F.floor("price_kes"), F.floor("price_kes") + F.col("observation_id") % 2
    raw = F.concat(F.lit("was KSh "), F.format_number(a, 0), F.lit(" now KES "), F.format_number(b, 0), F.lit(" or KSh 20"))
    return t.prices.select("observation_id", T.currency_prices(raw, 1000, 5_000_000).alias("prices"))


@query("p8", "select observation_id, try_cast(regexp_extract(replace(format('{:,}', views * 1000) || ' likes', ',', ''), '-?[0-9]+') as bigint) as metric from social")
def p8(t):
    return t.social.select("observation_id", T.parse_metric(F.concat(F.format_number(F.col("views") * 1000, 0), F.lit(" likes"))).alias("metric"))


@query("p9", "select observation_id, case when price_kes <> 0 then floor((price_kes * (1 - discount) - price_kes) / price_kes * 100 * 100 + 0.5) / 100 end as pct from prices")
def p9(t):
    return t.prices.select("observation_id", T.pct_change(F.col("price_kes"), F.col("price_kes") * (1 - F.col("discount"))).alias("pct"))


@query("p10", "select observation_id, case when price_kes > 0 and price_kes - 100 < price_kes then floor((price_kes - (price_kes - 100)) / price_kes * 100 * 100 + 0.5) / 100 end as discount_pct from prices")
def p10(t):
    return t.prices.select("observation_id", T.discount_pct(F.col("price_kes"), F.col("price_kes") - 100).alias("discount_pct"))


@query("p11", """select observation_id, 'KSh ' || format('{:,}', cast(floor(price_kes) as bigint)) || ' -> KSh ' || format('{:,}', cast(floor(price_kes * (1 - discount)) as bigint))
    || ' (' || cast(cast(floor(discount * 100 + 0.5) as bigint) as varchar) || '% off)' as offer, concat_ws('; ', case when discount > 0.05 then 'On sale' end, 'Model ' || model) as note from prices""")
def p11(t):
    money = lambda c: F.format_number(F.floor(c), 0)
    offer = F.concat(F.lit("KSh "), money(F.col("price_kes")), F.lit(" -> KSh "), money(F.col("price_kes") * (1 - F.col("discount"))),
                     F.lit(" ("), F.floor(F.col("discount") * 100 + 0.5).cast("string"), F.lit("% off)"))
    note = F.concat_ws("; ", F.when(F.col("discount") > 0.05, "On sale"), F.concat(F.lit("Model "), "model"))
    return t.prices.select("observation_id", offer.alias("offer"), note.alias("note"))


@query("p12", "select observation_id, isoyear(observed_date) || '-W' || lpad(cast(weekofyear(observed_date) as varchar), 2, '0') as scan_week from prices")
def p12(t):
    return t.prices.select("observation_id", T.iso_week(F.col("observed_date")).alias("scan_week"))


@query("p13", "select observation_id, observed_date as iso, observed_date as worded, observed_date as rfc, cast(null as date) as junk from prices")
def p13(t):
    d = F.col("observed_date")
    parse = lambda c: T.parse_datetime(c).cast("date")
    rfc = F.date_format(d.cast("timestamp"), "EEE, d MMM yyyy HH:mm:ss Z")
    return t.prices.select("observation_id", parse(d.cast("string")).alias("iso"), parse(F.date_format(d, "d MMMM yyyy")).alias("worded"),
                           parse(rfc).alias("rfc"), parse(F.lit("soon")).alias("junk"))


@query("p14", "select event_id, cast(ts as timestamp) - to_minutes(cast((event_id % 40) * case event_id % 3 when 0 then 1 when 1 then 60 else 1440 end as integer)) as published from social")
def p14(t):
    unit = F.element_at(F.array(F.lit("mins"), F.lit("hours"), F.lit("days")), (F.col("event_id") % 3 + 1).cast("int"))
    said = F.concat((F.col("event_id") % 40).cast("string"), F.lit(" "), unit, F.lit(" ago"))
    return t.social.select("event_id", T.relative_time(said, F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("published"))


@query("p15", "select news_id, 'http://news.' || publisher || '.example.com/a/' || (news_id % 700) || '/?id=' || (news_id % 700) as url from news")
def p15(t):
    return t.news.select("news_id", T.canonical_url(F.col("source_url")).alias("url"))


@query("p16", "select page_id, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://([^/?#]*)', 1), '^www[.]', '') || regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') as identity from pages")
def p16(t):
    return t.raw("pages").select("page_id", T.url_identity(F.col("url")).alias("identity"))


@query("p17", "select page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://([^/?#]*)', 1) as domain, url as target from pages")
def p17(t):
    wrapped = F.concat(F.lit("https://find.example.com/ck?p=1&u="), F.url_encode(F.url_encode("url")))
    return t.raw("pages").select("page_id", T.host_of(F.col("url")).alias("domain"), T.redirect_target(wrapped).alias("target"))


@query("p18", """select news_id, case when length(headline) > 60 then rtrim(substr(headline, 1, 57)) || '...' else headline end as short,
    case when length(headline) > 60 then regexp_replace(substr(headline, 1, 61), '\\s*\\S*$', '') else headline end as words from news""")
def p18(t):
    return t.news.select("news_id", T.truncate(F.col("headline"), 60).alias("short"), T.truncate_words(F.col("headline"), 60).alias("words"))


@query("p19", """select news_id, case when pos > 0 then substr(body, greatest(pos - 220, 1), pos + 5 + 220 - greatest(pos - 220, 1)) else '' end as context
    from (select news_id, coalesce(body, '') as body, strpos(coalesce(body, ''), ' the ') as pos from news)""")
def p19(t):
    return t.news.select("news_id", T.around(F.coalesce("body", F.lit("")), F.lit(" the "), 220).alias("context"))


@query("p20")
def p20(t):
    return t.news.select("news_id", T.summarize("body").alias("summary"))


@query("p21", """select campaign_id, case when start_date is null and end_date is null then 'date not recorded' when start_date is null then cast(end_date as varchar)
    when end_date is null or start_date = end_date then cast(start_date as varchar) else start_date || ' to ' || end_date end as period from campaigns""")
def p21(t):
    return t.campaigns.select("campaign_id", T.period_label(F.col("start_date"), F.col("end_date")).alias("period"))


@query("p22", """select observation_id, 'CI-' || strftime(observed_date, '%Y-%m') || '-' || lpad(cast(100 + row_number() over (
    partition by strftime(observed_date, '%Y-%m') order by observation_id) as varchar), 6, '0') as finding_id from prices""")
def p22(t):
    last = t.prices.select(F.date_format("observed_date", "yyyy-MM").alias("month")).distinct().withColumn("last", F.lit(100))
    return S.mint_ids(t.prices.withColumn("month", F.date_format("observed_date", "yyyy-MM")), last, ["observation_id", "model", "price_kes"], 6).select("observation_id", "finding_id")


@query("p23", "select news_id, substr(sha1('http://news.' || publisher || '.example.com/a/' || (news_id % 700) || '/?id=' || (news_id % 700)), 1, 16) as id from news")
def p23(t):
    return t.news.select("news_id", T.hash_id(T.canonical_url(F.col("source_url"))).alias("id"))


@query("p24", "select p_brand as brand, p_name as item_name, cast(p_partkey as varchar) as model_no, p_type as raw_category, cast(null as varchar) as product_url from part")
def p24(t):
    aliases = {"brand": ["Brand", "p_brand"], "item_name": ["name", "title", "p_name"], "model_no": ["sku", "P_PARTKEY"], "raw_category": ["p_type"], "product_url": ["url", "link"]}
    return S.resolve_aliases(t.raw("part"), aliases)


@query("p25", """select observation_id, case when discount >= 0.07 then 'promotion' when discount >= 0.04 then 'regular' else 'unspecified' end as price_type from prices""")
def p25(t):
    d = F.col("discount")
    label = F.when(d >= 0.07, "Special OFFER price").when(d >= 0.04, "Regular price").otherwise("price")
    return t.prices.select("observation_id", S.price_type(label).alias("price_type"))


# ---------------------------------------------------------------- F: filters


@query("f1", f"select observation_id, observed_date from prices where observed_date >= date '{AS_OF}' - 7")
def f1(t):
    return t.prices.where(F.col("observed_date") >= F.date_sub(F.lit(AS_OF).cast("date"), 7)).select("observation_id", "observed_date")


@query("f2", f"select competitor_id, identifier, first_seen_date from catalogue where first_seen_date between date '{AS_OF}' - 6 and date '{AS_OF}'")
def f2(t):
    day = F.lit(AS_OF).cast("date")
    return t.catalogue.where(F.col("first_seen_date").between(F.date_sub(day, 6), day)).select("competitor_id", "identifier", "first_seen_date")


@query("f3", f"select competitor_id, identifier, first_seen_date from catalogue where first_seen_date > date '{BASELINE}'")
def f3(t):
    return t.catalogue.where(F.col("first_seen_date") > F.lit(BASELINE).cast("date")).select("competitor_id", "identifier", "first_seen_date")


TERMS = ["license", "licensed", "token", "offer"]


@query("f4", "select news_id, list_filter(['license', 'licensed', 'token', 'offer'], lambda x: contains(lower(body), x)) as terms from news where contains(lower(body), 'license') or contains(lower(body), 'token') or contains(lower(body), 'offer')")
def f4(t):
    found = t.news.select("news_id", found_in(F.col("body"), TERMS, whole=False, once=True).alias("terms"))
    return found.where("size(terms) > 0")


@query("f5", """select page_id, case when host = 'cheap-pills.example.com' or ends_with(host, '.cheap-pills.example.com') then 'blocked'
    when ends_with(host, '.org') then 'preferred' when ends_with(host, '.net') then 'allowed' else 'other' end as source_class from
    (select page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://([^/?#]*)', 1) as host from pages)""")
def f5(t):
    host = T.host_of(F.col("url"))
    lists = {"blocked": ["cheap-pills.example.com"], "preferred": ["org"], "allowed": ["net"]}
    return t.raw("pages").select("page_id", S.domain_class(host, lists).alias("source_class"))


@query("f6", """select page_id from pages where regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://([^/?#]*)', 1) <> '' and regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) not in ('', '/')
    and not regexp_matches(lower(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1)), '[.](html|pdf|jpg)$')""")
def f6(t):
    return t.raw("pages").where(S.looks_like_article(F.col("url"), ["html", "pdf", "jpg"])).select("page_id")


@query("f7", """select observation_id, case when likes is null then 'no metrics' when social_type not in ('view', 'click', 'purchase') then 'unsupported type'
    when published_date < date '2024-01-20' then 'outside window' when length(post_text) < 20 then 'text too short' end as reject_reason from social""")
def f7(t):
    rules = [(F.col("likes").isNull(), "no metrics"), (~F.col("social_type").isin("view", "click", "purchase"), "unsupported type"),
             (F.col("published_date") < "2024-01-20", "outside window"), (F.length("post_text") < 20, "text too short")]
    return t.social.select("observation_id", T.first_rule(rules).cast("string").alias("reject_reason"))


@query("f8", "select observation_id from social where platform <> 'x' and (account_name in ('account1', 'account2') or (contains(post_text, 'purchase') and contains(post_text, 'offer')))")
def f8(t):
    text = F.col("post_text")
    direct = F.col("account_name").isin("account1", "account2")
    return t.social.where((F.col("platform") != "x") & (direct | (text.contains("purchase") & text.contains("offer")))).select("observation_id")


@query("f9", "select news_id from news where contains(lower(coalesce(body, '')), 'license') and not contains(lower(coalesce(body, '')), 'apache')")
def f9(t):
    low = F.lower(F.coalesce("body", F.lit("")))
    return t.news.where(T.contains_any(low, ["license"]) & ~T.contains_any(low, ["apache"])).select("news_id")


ACTIVE = f"""not (start_date is null and end_date is null) and (start_date is null or start_date <= date '{AS_OF}') and (end_date is null or end_date >= date '{AS_OF}')"""


@query("f10", f"select campaign_id from campaigns where {ACTIVE}")
def f10(t):
    return t.campaigns.where(S.active_on(F.lit(AS_OF).cast("date"))).select("campaign_id")


@query("f11", f"""select campaign_id, 'active' as listing from campaigns where start_date <= date '{AS_OF}' and (end_date is null or end_date >= date '{AS_OF}') and status <> 'ended'
    union all select campaign_id, 'upcoming' from campaigns where start_date > date '{AS_OF}' and status = 'upcoming'""")
def f11(t):
    day = F.lit(AS_OF).cast("date")
    open_now = (F.col("start_date") <= day) & (F.col("end_date").isNull() | (F.col("end_date") >= day)) & (F.col("status") != "ended")
    coming = (F.col("start_date") > day) & (F.col("status") == "upcoming")
    return t.campaigns.select("campaign_id", F.when(open_now, "active").when(coming, "upcoming").alias("listing")).where("listing is not null")


@query("f12", """select observation_id from prices p join competitors c using (competitor_id) where c.competitor_id = 7 or (p.brand = 'Brand#3')
    or (c.brand_name = 'NATION_7' and (select count(*) from competitors where brand_name = 'NATION_7') = 1)""")
def f12(t):
    one = t.competitors.where("brand_name = 'NATION_7'").agg(F.count("*").alias("n_scope"))
    j = t.prices.join(t.competitors, "competitor_id").crossJoin(F.broadcast(one))
    return j.where((F.col("competitor_id") == 7) | (F.col("brand") == "Brand#3") | ((F.col("brand_name") == "NATION_7") & (F.col("n_scope") == 1))).select("observation_id")


@query("f13", """select news_id, case when regexp_matches(lower(coalesce(headline, '')), 'rights reserved|licensed under|released under') then true else false end as boilerplate,
    regexp_extract(coalesce(body, ''), '^(?s)(.*?)(?:\\z|Licensed under|All rights reserved|Released under)', 1) as kept from news""")
def f13(t):
    marks = ["Licensed under", "All rights reserved", "Released under"]
    kept = F.split(F.coalesce("body", F.lit("")), "|".join(marks), 2)[0]
    low = F.lower(F.coalesce("headline", F.lit("")))
    return t.news.select("news_id", low.rlike("rights reserved|licensed under|released under").alias("boilerplate"), kept.alias("kept"))


@query("f14", "select finding_id, source_url from findings where competitor_id = 5 and verification_status = 'VERIFIED' and confidence = 'HIGH'")
def f14(t):
    t.findings.createOrReplaceTempView("loom_findings")
    text = "select finding_id, source_url from loom_findings where competitor_id = :competitor and verification_status = :status and confidence = :confidence"
    return t.spark.sql(text, args={"competitor": 5, "status": "VERIFIED", "confidence": "HIGH"})


@query("f15", "select competitor_id, secondary_url from competitors where secondary_url is not null and competitor_id % 2 = 1")
def f15(t):
    c = t.competitors.withColumn("active", F.col("competitor_id") % 2 == 1).withColumn("verified", F.lit(False))
    return S.list_sources(c, active_only=True, urls_only="secondary_url").select("competitor_id", "secondary_url")


@query("f16", "select finding_id from findings where lower(coalesce(brand, '')) like '%brand#11%' or lower(coalesce(summary, '')) like '%steel%' or lower(coalesce(finding_type, '')) like '%promo%'")
def f16(t):
    return S.search(t.findings, {"brand": "Brand#11", "summary": "steel", "finding_type": "promo"}).select("finding_id")


@query("f17", "select campaign_id, campaign_type, status from campaigns where campaign_type = 'O' and status in ('active', 'upcoming')")
def f17(t):
    return t.campaigns.where(F.col("campaign_type").isin("O") & F.col("status").isin("active", "upcoming")).select("campaign_id", "campaign_type", "status")


# ---------------------------------------------------------------- S: sources and sinks


@query("s1", "select observation_id, competitor_id, product_name, model, price_kes, observed_date from prices where price_kes is not null")
def s1(t):
    return t.prices.where("price_kes is not null").select("observation_id", "competitor_id", "product_name", "model", "price_kes", "observed_date")


@query("s2", """select 'catalogue' as source, identifier, product_name, category from catalogue union all select 'canonical', model_no, item_name, category from canonical
    union all select 'part', cast(p_partkey as varchar), p_name, p_type from part""")
def s2(t):
    maps = [("catalogue", t.catalogue, {"identifier": "identifier", "product_name": "product_name", "category": "category"}),
            ("canonical", t.canonical, {"identifier": "model_no", "product_name": "item_name", "category": "category"}),
            ("part", t.raw("part"), {"identifier": "p_partkey", "product_name": "p_name", "category": "p_type"})]
    return S.one_shape(maps)


@query("s3", "select brand, cast(product_id as varchar) as product_id, item_name, model_no from canonical")
def s3(t):
    path = S.write_csv(t.canonical, ["product_id", "brand", "item_name", "model_no"], S.scratch(t.spark, "s3"))
    return S.read_catalogue_csv(t.spark, path).select("brand", "product_id", "item_name", "model_no")


@query("s4", "select news_id, publisher, headline, scope_status from news")
def s4(t):
    path = S.write_json(t.news.select("news_id", "publisher", "headline", "scope_status"), S.scratch(t.spark, "s4"))
    return S.read_articles_json(t.spark, path, "news_id long, publisher string, headline string, scope_status string")


@query("s5", "select observation_id, competitor_id, platform, account_name, post_url, post_text, social_type, published_date, observed_date from social")
def s5(t):
    return t.social.select("observation_id", "competitor_id", "platform", "account_name", "post_url", "post_text", "social_type", "published_date", "observed_date")


@query("s6", """select 'finding' as source, finding_id as row_id, case when finding_type = 'price' then concat_ws(' ', model, summary) else concat_ws(' ', summary, substr(source_url, 1, 300)) end as text
    from findings join (select observation_id, model from prices) using (observation_id) union all select 'canonical', cast(product_id as varchar), item_name from canonical""")
def s6(t):
    f = t.findings.join(t.prices.select("observation_id", "model"), "observation_id", "left")
    text = F.when(F.col("finding_type") == "price", F.concat_ws(" ", "model", "summary")).otherwise(F.concat_ws(" ", F.col("summary"), F.substring("source_url", 1, 300)))
    a = f.select(F.lit("finding").alias("source"), F.col("finding_id").alias("row_id"), text.alias("text"))
    return a.unionByName(t.canonical.select(F.lit("canonical").alias("source"), F.col("product_id").cast("string").alias("row_id"), F.col("item_name").alias("text")))


@query("s7", "select campaign_id, campaign_name, status from campaigns")
def s7(t):
    path = S.write_csv(t.campaigns, ["campaign_id", "campaign_name", "status"], S.scratch(t.spark, "s7"))
    return t.spark.read.csv(path, header=True, schema="campaign_id long, campaign_name string, status string")


@query("s8", "select platform, social_type, count(*) as n from social group by all")
def s8(t):
    d = t.social.groupBy("platform", "social_type").agg(F.count("*").alias("n"))
    return t.spark.read.schema("platform string, social_type string, n long").json(S.write_json(d, S.scratch(t.spark, "s8")))


KIND = "case when discount >= 0.08 then 'promotion' when return_flag = 'R' then 'news' else 'price' end"


@query("s9", f"""select finding_id, observation_id, finding_type, case finding_type when 'price' then cast(price_kes as varchar) when 'promotion' then cast(discount as varchar) else product_name end as detail from
    (select *, {KIND} as finding_type, 'CI-' || strftime(observed_date, '%Y-%m') || '-' || lpad(cast(row_number() over (partition by strftime(observed_date, '%Y-%m') order by observation_id, model, price_kes) as varchar), 6, '0') as finding_id from prices)""")
def s9(t):
    none = t.spark.createDataFrame([], "month string, last int")
    head, child = S.split_header_children(t.prices.withColumn("finding_type", F.expr(KIND)), none, {"price": ["price_kes"], "promotion": ["discount"], "news": ["product_name"]})
    a = S.append(head, S.scratch(t.spark, "s9-findings"))
    stored = {k: S.append(df, S.scratch(t.spark, f"s9-{k}")) for k, df in child.items()}
    detail = lambda k, c: a.where(F.col("finding_type") == k).join(stored[k].select("finding_id", F.col(c).cast("string").alias("detail")), "finding_id")
    rows = detail("price", "price_kes").unionByName(detail("promotion", "discount")).unionByName(detail("news", "product_name"))
    return rows.select("finding_id", "observation_id", "finding_type", "detail")


@query("s10", """select scan_week, count(*) as runs, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed, cast(sum(declared) as bigint) as findings from runs group by scan_week""")
def s10(t):
    return S.ledger(t.runs)


@query("s11")
def s11(t):
    return PG.product_cards(t.raw("pages"))


@query("s12")
def s12(t):
    return PG.article_fields(t.raw("pages"))


@query("s13", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as likes, 'https://social.example.com/' || event_id as post_url, event_type as post_text from events")
def s13(t):
    inner = F.struct(F.struct(F.concat(F.lit("https://social.example.com/"), "event_id").alias("post_link")).alias("details"),
                     F.struct(F.col("event_type").alias("text")).alias("values"), F.struct(F.get_json_object("props", "$.k").cast("long").alias("total_reaction_count")).alias("reactions"))
    payload = t.raw("events").select("event_id", F.to_json(F.struct(F.array(inner).alias("data"))).alias("payload"))
    return S.provider_posts(payload).select("event_id", "likes", "post_url", "post_text")


@query("s14", "select distinct product_id, item_name, model_no from canonical")
def s14(t):
    rows = t.canonical.withColumn("bucket", F.col("product_id") % 64)
    one = F.to_json(F.struct(F.col("product_id").alias("id"), F.col("item_name").alias("name"), F.col("model_no").alias("model")))
    pages = rows.groupBy("bucket").agg(F.concat(F.lit("<script>var items=["), F.array_join(F.collect_list(one), ","), F.lit("];</script>")).alias("html"))
    return S.embedded_items(pages).select("product_id", "item_name", "model_no")


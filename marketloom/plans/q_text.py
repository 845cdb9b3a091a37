"""Queries of text classification and extraction. Term lists are parameters, set to words that the test tables have."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import taxonomy as X
from ..functions import text as T
from ..functions.dictionary import found_in_lists
from ..operators import catalogue as C
from ..operators import matching as M
from ..operators import news as N
from ..operators import reports as R
from ..operators import signals as G
from .bind import BASELINE, half_up
from .q_catalogue import TITLE, family_sql, features_sql, plain_sql
from .q_signals import CAMPAIGNS, POSTED
from .registry import query

RULES = (
    X.CategoryRule("Tools", "Bolts", 90, "bolt"), X.CategoryRule("Tools", "Rods", 80, r"\brods?\b"), X.CategoryRule("Home", "Plates", 85, "plate"), X.CategoryRule("Home", "Cold", 84, r"^cold\b", "weak"),
    X.CategoryRule("Gadgets", "Gizmos", 60, "gi[sz]mo"), X.CategoryRule("Gadgets", "Gadgets - other", 10, "widget", "category"),
)
RAW = {"economy": ("Budget", "Economy", "specific"), "promo": ("Home", "Home - other", "category")}
SLUGS = {"glass-plate": ("Home", "Glass", "specific"), "glass-ring": ("Jewels", "Jewels - other", "category"), "economy": ("Budget", "Economy", "specific")}
#: Words that the test products get, so that every outcome occurs.
OFFERED = """item_name || case product_id % 11 when 0 then ' with bolt, Gizmo and plate' when 1 then ' up to 50% off' when 2 then ' and widget' else '' end"""
SLUG = "lower(category) || ', Glass-' || sub_category"


def classified_sql(text, raw, maps, source, key):
    """The classification of canonical products by unnested rules; maps: rows of key, category, sub-category, level."""
    return rf"""with rows_ as (select product_id, {text} as text, {raw} as raw from canonical), hits as (
        select product_id, i, category, sub, level, 'name' as source, p from rows_ join (values (1, 'Tools', 'Bolts', 90, 'bolt', 'specific'), (2, 'Tools', 'Rods', 80, '\brods?\b', 'specific'), (3, 'Home', 'Plates', 85, 'plate', 'specific'),
            (4, 'Home', 'Cold', 84, '^cold\b', 'weak'), (5, 'Gadgets', 'Gizmos', 60, 'gi[sz]mo', 'specific'), (6, 'Gadgets', 'Gadgets - other', 10, 'widget', 'category')) r(i, category, sub, p, rx, level) on regexp_matches(text, rx, 'i')
        union all select product_id, 100 + place, category, sub, level, '{source}', if(level = 'specific', 50, 5) from (select product_id, unnest({key}) as k, generate_subscripts({key}, 1) as place from rows_) join (values {maps}) m(name, category, sub, level) on k = name
    ), kept as (
        select *, case when bool_or(level = 'specific') over w then level = 'specific' when bool_or(level = 'weak') over w then level = 'weak' else true end as chosen, bool_or(level <> 'category') over w as sure from hits window w as (partition by product_id)
    ), best as (
        select product_id, any_value(sure) as sure, count(distinct category) as n, list_sort(list(distinct category)) as cats, arg_max({{'c': category, 's': sub}}, p * 1000 - i) as b,
            list_sort(list(distinct category || if(sure, ' / ' || sub, '') || ' (' || source || ')')) as told from kept where chosen group by product_id
    ), sources as (
        select k.product_id, string_agg(distinct source, '+' order by source) as s from kept k join best b on k.product_id = b.product_id where chosen and (not b.sure or sub = b.b.s) group by k.product_id
    )
    select r.product_id, case when n is null and wide then 'Multi-category' when n is null then '' when sure and n >= 3 then 'Multi-category' when n > 1 then '' else b.b.c end as category,
        case when n = 1 then b.b.s else '' end as sub_category, case when n is null and wide or sure and n >= 3 then 'low' when n is null or n > 1 then '' when sure then 'high' else 'medium' end as confidence,
        if(n = 1, 'mapped', 'review') as status, case when n is null and wide then 'text_pattern' when n is null then 'none' when sure and n >= 3 then 'multi_category' when n > 1 then 'conflict' else s.s end as method,
        case when n is null and wide then 'offer spans many categories, no product named' when n is null then 'no rule matched' when sure and n >= 3 then 'names products in several categories: ' || array_to_string(cats, ', ')
            when n > 1 then 'conflict: ' || array_to_string(told, '; ') else '' end as reason
    from (select *, regexp_matches(text, 'up to \d+% off', 'i') or lower(trim(raw)) in ('multiple', 'general appliances') as wide from rows_) r left join best b on r.product_id = b.product_id left join sources s on r.product_id = s.product_id"""


@query("c1", classified_sql(OFFERED, "raw_category", "('economy', 'Budget', 'Economy', 'specific'), ('promo', 'Home', 'Home - other', 'category')", "raw", "[lower(trim(raw))]"))
def c1(t):
    return t.canonical.select("product_id", X.classify(F.expr(OFFERED), F.col("raw_category"), RULES, RAW).alias("s")).select("product_id", "s.*")


@query("c1_slugs", classified_sql(OFFERED, SLUG, "('glass-plate', 'Home', 'Glass', 'specific'), ('glass-ring', 'Jewels', 'Jewels - other', 'category'), ('economy', 'Budget', 'Economy', 'specific')", "slug", "list_transform(string_split(lower(raw), ','), lambda x: trim(x))"))
def c1_slugs(t):
    """The same with the slugs of a web shop in place of raw categories."""
    return t.canonical.select("product_id", X.classify(F.expr(OFFERED), F.expr(SLUG), RULES, slug_map=SLUGS).alias("s")).select("product_id", "s.*")


#: One precedence list for each catalogue and a general one.
CATALOGUES = {
    "Brand#2": (
        X.OrderedRule("Refrigeration", "Freezers", ("freezer",)), X.OrderedRule("Refrigeration", "Refrigerators", ("fridge", "refrigerator"), (), ("box",)),
        X.OrderedRule("Air & Climate", "Air Conditioners", ("air conditioner", "split air")), X.OrderedRule("Cooking", "Gas Cookers", (), ("gas", "cooker")), X.OrderedRule("Home", "Other", ("plate", "ring"), confidence="medium"),
    ),
    "Brand#3": (X.OrderedRule("TV & Audio", "Televisions", ("smart tv", "/p/tv-")), X.OrderedRule("Cooking", "Hoods", ("hood",), (), ("gas",), "medium", "accessory"), X.OrderedRule("Cooking", "Cookers", ("cooker",))),
    "Brand#4": (X.OrderedRule("Refrigeration", "Small Boxes", (), ("fridge", "box"), (), "low"), X.OrderedRule("Refrigeration", "Fridges", ("fridge",)), X.OrderedRule("Tools", "Bolts", ("bolt",))),
}
GENERAL = (X.OrderedRule("Air & Climate", "Air Conditioners", ("btu", "split ac")), X.OrderedRule("Refrigeration", "Refrigerators", ("fridge",)), X.OrderedRule("Unsorted", "Gizmos", ("gizmo",), (), ("60 cm",), "low"))


@query("c2", f"""select brand, product_id, c.category, c.sub_category, coalesce(c.status, 'review') as status, coalesce(c.confidence, 'low') as confidence, c.scope from (select brand, product_id, case
    when brand = 'Brand#2' then case when contains(x, 'freezer') then ['Refrigeration', 'Freezers', 'high', 'core_appliance'] when (contains(x, 'fridge') or contains(x, 'refrigerator')) and not contains(x, 'box') then ['Refrigeration', 'Refrigerators', 'high', 'core_appliance']
        when contains(x, 'air conditioner') or contains(x, 'split air') then ['Air & Climate', 'Air Conditioners', 'high', 'core_appliance'] when contains(x, 'gas') and contains(x, 'cooker') then ['Cooking', 'Gas Cookers', 'high', 'core_appliance']
        when contains(x, 'plate') or contains(x, 'ring') then ['Home', 'Other', 'medium', 'core_appliance'] end
    when brand = 'Brand#3' then case when contains(x, 'smart tv') or contains(x, '/p/tv-') then ['TV & Audio', 'Televisions', 'high', 'core_appliance'] when contains(x, 'hood') and not contains(x, 'gas') then ['Cooking', 'Hoods', 'medium', 'accessory'] when contains(x, 'cooker') then ['Cooking', 'Cookers', 'high', 'core_appliance'] end
    when brand = 'Brand#4' then case when contains(x, 'fridge') and contains(x, 'box') then ['Refrigeration', 'Small Boxes', 'low', 'core_appliance'] when contains(x, 'fridge') then ['Refrigeration', 'Fridges', 'high', 'core_appliance'] when contains(x, 'bolt') then ['Tools', 'Bolts', 'high', 'core_appliance'] end
    else case when contains(x, 'btu') or contains(x, 'split ac') then ['Air & Climate', 'Air Conditioners', 'high', 'core_appliance'] when contains(x, 'fridge') then ['Refrigeration', 'Refrigerators', 'high', 'core_appliance'] when contains(x, 'gizmo') and not contains(x, '60 cm') then ['Unsorted', 'Gizmos', 'low', 'core_appliance'] end
    end as r from (select brand, product_id, lower({TITLE} || ' ' || product_url) as x from canonical)), lateral (select r[1] as category, r[2] as sub_category, if(r is null, null, 'mapped') as status, r[3] as confidence, r[4] as scope) c""")
def c2(t):
    """One operator, a precedence list for each source and a general one for all others."""
    text, brand = F.concat_ws(" ", F.expr(TITLE), "product_url"), F.col("brand")
    named = t.canonical.select("brand", "product_id", text.alias("text"))
    out = named.where(~brand.isin(*CATALOGUES)).withColumn("s", X.assign(F.col("text"), GENERAL))
    for name, rules in CATALOGUES.items():
        out = out.unionByName(named.where(brand == name).withColumn("s", X.assign(F.col("text"), rules)))
    return out.select("brand", "product_id", "s.*")


@query("c3", "select product_id, case when category is null then 'other' when lower(sub_category) in ('rod', 'bolt') then 'accessory' else 'core' end as scope from canonical")
def c3(t):
    return t.canonical.select("product_id", X.product_scope(F.col("category"), F.col("sub_category"), ["rod", "bolt"]).alias("scope"))


@query("c4", """select product_id, reasons from (select product_id, list_filter([case when mapping_confidence = 'LOW' then 'low confidence' end, case when mapping_status = 'REVIEW' then 'unmapped' end,
    case when model_no = '' then 'no model' end, case when product_scope <> 'core' then 'not a core product' end], lambda x: x is not null) as reasons from canonical) where len(reasons) > 0""")
def c4(t):
    return t.canonical.select("product_id", C.suspicious_reasons(t.canonical).alias("reasons")).where(F.size("reasons") > 0)


@query("c5", "select product_id, sub_category, case sub_category when 'gizmo' then 'gadget' when 'rod' then 'bar' end as canonical_name from canonical where sub_category in ('gizmo', 'rod')")
def c5(t):
    names = t.spark.createDataFrame([("gizmo", "gadget"), ("rod", "bar")], "sub_category string, canonical_name string")
    return t.canonical.join(names, "sub_category").select("product_id", "sub_category", "canonical_name")


@query("c6", "select product_id, case when contains(item_name, 'bolt') then 'Fasteners' when contains(item_name, 'plate') or contains(item_name, 'ring') then 'Tableware' else 'Other' end as inferred from canonical")
def c6(t):
    low = F.lower("item_name")
    return t.canonical.select("product_id", T.first_rule([(T.contains_any(low, ["bolt"]), "Fasteners"), (T.contains_any(low, ["plate", "ring"]), "Tableware")], "Other").alias("inferred"))


@query("c7", "select product_id, case when starts_with(item_name, 'red ') then 'Red' when starts_with(item_name, 'blue ') then 'Blue' end as brand from canonical")
def c7(t):
    return t.canonical.select("product_id", X.brand_from_title(F.col("item_name"), ["Red", "Blue"]).alias("brand"))


@query("c8", "select product_id, case product_id % 3 when 0 then 'XK-' || product_id when 1 then 'AB' || product_id || 'C' else 'ID' || product_id end as model from canonical")
def c8(t):
    title = F.expr("case product_id % 3 when 0 then item_name || ' Model: xk-' || product_id when 1 then item_name || ' AB' || product_id || 'C white' else item_name end")
    return t.canonical.select("product_id", X.model_from_title(title, F.concat(F.lit("ID"), "product_id")).alias("model"))


@query("c9", """select product_id, case when model_no = '' then 'missing' when length(model_no) < 4 then 'weak' else 'reliable' end as quality from canonical""")
def c9(t):
    return t.canonical.select("product_id", C.model_quality(F.col("model_no")).alias("quality"))


@query("c10", "select product_id, case when model_no <> '' then model_no else brand || ' | ' || category || ' | ' || item_name end as identity from canonical")
def c10(t):
    return t.canonical.select("product_id", C.identity_string(F.col("model_no"), F.col("brand"), F.col("category"), F.col("item_name")).alias("identity"))


TALKED = "post_text || case observation_id % 7 when 0 then ' Freezers and a tv' when 1 then ' a Kettle, oven' when 2 then ' soundbar' when 3 then ' fan of water  heater' else '' end"


@query("c11", f"""select observation_id, case when contains(post_text, 'purchase') then 'promotion' when contains(post_text, 'error') then 'complaint' else 'activity' end as social_kind, case observation_id % 7 when 0 then 'Refrigeration' when 1 then 'Cooking' when 2 then 'TV & Audio' when 3 then 'Air & Climate' end as focus,
    trim(substr(post_text, case when contains(post_text, 'click') and contains(post_text, 'offer') then least(strpos(post_text, 'click'), strpos(post_text, 'offer')) else strpos(post_text, 'offer') end, 20)) as phrase from social""")
def c11(t):
    text = F.col("post_text")
    kind = T.first_rule([(T.contains_any(text, ["purchase"]), "promotion"), (T.contains_any(text, ["error"]), "complaint")], "activity")
    return t.social.select("observation_id", kind.alias("social_kind"), X.product_focus(F.expr(TALKED)).alias("focus"), X.phrase_near(text, ["click", "offer"], 20).alias("phrase"))


FOUND_AS = "case page_id % 5 when 0 then 'Big Sale' when 1 then 'a new arrival' when 2 then 'Unveiled with a deal' else null end"


@query("c12", f"select page_id, case when regexp_matches(x, 'promotion|promo|offer|discount|sale|deal|giveaway') then 'promotion' when regexp_matches(x, 'launch|new product|new arrival|introduced|unveiled') then 'product' else 'activity' end as result_type from (select page_id, lower(coalesce({FOUND_AS}, '') || ' ' || coalesce(url, '')) as x from pages)")
def c12(t):
    return t.raw("pages").select("page_id", X.result_type(F.expr(FOUND_AS), F.col("url")).alias("result_type"))


def _terms(c, words):
    return f"list_filter([{', '.join(repr(w) for w in words)}], lambda x: regexp_matches({c}, '(^|[^a-z0-9])' || x || '([^a-z0-9]|$)'))"


ENTITIES, TOPICS = ["license", "token", "apache", "mit"], ["the", "of", "die", "les"]
LOW = "lower(coalesce(body, ''))"


@query("c13", f"select news_id, {_terms(LOW, ENTITIES)} as entities from news")
def c13(t):
    return t.news.select("news_id", N.terms_in(F.coalesce("body", F.lit("")), ENTITIES).alias("entities"))


@query("c14", f"""select news_id, list_filter([case when len({_terms("b", ['the', 'of'])}) > 0 then 'english' end, case when len({_terms("b", ['die', 'der'])}) > 0 then 'german' end], lambda x: x is not null) as categories
    from (select news_id, regexp_replace({LOW}, 'all rights reserved', ' ', 'g') as b from news)""")
def c14(t):
    rules = {"english": ["the", "of"], "german": ["die", "der"]}
    return t.news.select("news_id", N.categories_in(F.coalesce("body", F.lit("")), rules, "all rights reserved").alias("categories"))


#: What the test articles say besides: every type and scope occurs.
SAID = """case news_id % 8 when 0 then ' Partners in a joint venture' when 1 then ' a new outlet opens' when 2 then ' enters with a Factory' when 3 then ' a roadshow' when 4 then ' demand and growth' else '' end"""
LOCAL = ["est", "der", "para"]
SUBJECT = f"trim(regexp_replace(lower(headline || {SAID}), '\\s+', ' ', 'g')) || ' ' || substr(trim(regexp_replace({LOW}, '\\s+', ' ', 'g')), 1, 800)"


def _any(c, words):
    return f"len({_terms(c, words)}) > 0"


TYPE_SQL = "case " + " ".join(f"when {'e > 0 and ' if named else ''}{_any('s', w) if w else 'true'} then '{k}'" for k, w, named in N.TYPES) + " else 'INDUSTRY_NEWS' end"
READ = f"""(select *, {TYPE_SQL} as news_type from (select news_id, headline, source_url, published_date, coalesce(body, '') as b, len({_terms(LOW, ENTITIES)}) as e, len({_terms(LOW, TOPICS)}) as k, len({_terms(LOW, LOCAL)}) as l, {SUBJECT} as s from news))"""
SCOPE_STATUS = "case when e > 0 or (k > 0 and l > 0) then 'IN_SCOPE' when l > 0 then 'REVIEW' else 'OUT_OF_SCOPE' end"


def read_news(t):
    """Each article with its entities, products, local terms and type, the lists of the body in one pass."""
    lists = found_in_lists(F.coalesce("body", F.lit("")), {"entities": ENTITIES, "products": TOPICS, "local": LOCAL})
    subject = N.subject_text(F.concat("headline", F.expr(SAID)), F.col("body"))
    found = t.news.select("news_id", "headline", "body", "source_url", "published_date", subject.alias("subject"), lists.alias("l")).select("*", "l.*")
    return found.withColumn("news_type", N.news_type(F.col("subject"), F.col("entities")))


def scoped_news(t):
    return read_news(t).withColumn("s", N.scope(F.col("entities"), F.col("products"), F.col("local"), F.col("news_type")))


@query("c15", f"select news_id, news_type from {READ}")
def c15(t):
    return read_news(t).select("news_id", "news_type")


@query("c16", f"""select news_id, {SCOPE_STATUS} as status, case when e > 0 and (l > 0 or k > 0) then 'TRACKED_ENTITY_WITH_MARKET_ACTIVITY' when e > 0 then 'TRACKED_ENTITY' when k > 0 and l > 0 then 'LOCAL_PRODUCT_MARKET'
    when news_type = 'MARKET_DEVELOPMENT' and l > 0 then 'LOCAL_MARKET_NO_PRODUCT_SIGNAL' when l > 0 then 'LOCAL_REFERENCE_REQUIRES_MARKET_RELEVANCE_REVIEW' else 'NO_RELEVANT_MARKET_SIGNAL' end as reason from {READ}""")
def c16(t):
    return scoped_news(t).select("news_id", "s.status", "s.reason")


@query("c17", f"""select news_id, case when p >= 9 and length(b) >= 500 and web and (e > 0 or k > 0) and status = 'IN_SCOPE' then 'HIGH' when p >= 6 then 'MEDIUM' else 'LOW' end as confidence from
    (select *, if(trim(headline) <> '', 1, 0) + case when length(b) >= 1000 then 2 when length(b) >= 500 then 1 else 0 end + if(published_date is not null, 1, 0) + if(web, 1, 0) + if(e > 0, 2, 0) + if(k > 0, 1, 0)
    + case status when 'IN_SCOPE' then 1 when 'REVIEW' then -1 else 0 end as p from (select *, {SCOPE_STATUS} as status, news_id % 9 <> 0 as web from {READ}))""")
def c17(t):
    url = F.when(F.col("news_id") % 9 != 0, F.col("source_url"))
    c = N.confidence(F.col("headline"), F.col("body"), F.col("published_date").isNotNull(), url, F.col("entities"), F.col("products"), F.col("s.status"))
    return scoped_news(t).select("news_id", c.alias("confidence"))


@query("a23", f"""with r as (select news_type, {SCOPE_STATUS} as status from {READ}) select 'scope' as field, status as value, count(*) as n from r group by 2 union all select 'news_type', news_type, count(*) from r group by 2
    union all select * from (select 'mode', news_type, count(*) from r group by 2 order by 3 desc, 2 limit 1)""")
def a23(t):
    rows = scoped_news(t).select(F.col("s.status").alias("scope"), "news_type")
    return R.record_summary(rows, ["scope", "news_type"], mode="news_type")


@query("c18", f"""select news_id, cast(5 * l + 10 * e + 3 * k + if(contains(lower(publisher), 'web'), 8, 0) + if(contains(b, 'license') or contains(b, 'market') or contains(b, 'sales'), 5, 0) + case when age <= 2 then 5 when age <= 7 then 3 else 0 end as integer) as score from
    (select news_id, publisher, {LOW} as b, len({_terms(LOW, ENTITIES)}) as e, len({_terms(LOW, TOPICS)}) as k, len({_terms(LOW, LOCAL)}) as l, date '2024-02-20' - published_date as age from news)""")
def c18(t):
    body = F.coalesce("body", F.lit(""))
    found = t.news.select("news_id", "publisher", "published_date", body.alias("body"), found_in_lists(body, {"entities": ENTITIES, "products": TOPICS, "local": LOCAL}).alias("l")).select("*", "l.*")
    score = N.priority_score(F.col("local"), F.col("entities"), F.col("products"), F.col("publisher"), ["web"], F.col("body"), F.col("published_date"), "2024-02-20", ["license", "market", "sales"])
    return found.select("news_id", score.alias("score"))


def _times(c, pattern):
    return f"len(regexp_extract_all({c}, '{pattern}'))"


QUALITY_SQL = rf"""case when length(text) >= 1500 then 40 when length(text) >= 600 then 30 when length(text) >= 200 then 15 else 0 end + least({_times("text", r"[.!?](?: |\z)")}, 20)
    - least({_times("text", "[a-z][A-Z]")} * 2 + {_times("text", "<[^>]+>")} * 5 + {_times("text", "â€|Ã.")} * 5, 60)"""


@query("c19", f"""select news_id, r.q as quality, r.n as n_chars, title_quality from (select news_id, arg_max({{'q': cast(quality as integer), 'n': length(text)}}, {{'a': quality, 'b': length(text), 'c': -place}}) as r from (select *, {QUALITY_SQL} as quality from
    (select news_id, body as text, 0 as place from news where body is not null union all select news_id, concat_ws(' ', headline, body), 1 from news)) group by news_id)
    join (select news_id, case when t = '' then -1000.0 else if(length(t) between 20 and 180, 5.0, 0.0) - 4.0 * {_times("regexp_replace(t, '([a-z])([A-Z])', '\\1|\\2', 'g')", "[a-z][|][A-Z]")} - 2.0 * {_times("t", r"\b(?:the|a|an|and|or|to|of|in|on|for|with|from|into|that|how|is|are|can|will|you|your|our|their)[a-z]{4,}")} - if(contains(t, '|'), 1.0, 0.0) end as title_quality
        from (select news_id, regexp_replace(trim(regexp_replace(headline, '\\s+', ' ', 'g')), '[^\\x00-\\x7F]', '0', 'g') as t from news)) using (news_id)""")
def c19(t):
    a = t.news.select(F.col("news_id"), F.col("body").alias("text"), F.lit(0).alias("place"))
    b = t.news.select(F.col("news_id"), F.concat_ws(" ", "headline", "body").alias("text"), F.lit(1).alias("place"))
    best = N.best_text(a.unionByName(b), "news_id", "text", "place").select("news_id", "quality", F.length("text").alias("n_chars"))
    return best.join(t.news.select("news_id", N.title_quality(F.col("headline")).alias("title_quality")), "news_id")


SEEN_AS = "product_name || case observations % 5 when 0 then ' Now available' when 1 then ': introducing it' when 2 then ' launched today' when 3 then ' new arrival, just launched' else '' end"


@query("c20", f"""select competitor_id, identifier, if(new, 'FIRST_OBSERVED', 'BASELINE') as launch, case when not new then 'BASELINE' when competitor_id % 2 = 0 and regexp_matches(said, 'LAUNCH|LAUNCHED|LAUNCHING|INTRODUCING') then 'CONFIRMED_LAUNCH'
    when regexp_matches(said, 'NEW ARRIVAL|INTRODUCING|NEW PRODUCT|JUST LAUNCHED|NOW AVAILABLE') then 'LAUNCH_CANDIDATE' else 'FIRST_OBSERVED' end as evidence from (select *, first_seen_date > date '{BASELINE}' as new, upper({SEEN_AS}) as said from catalogue)""")
def c20(t):
    new = F.col("first_seen_date") > BASELINE
    evidence = C.launch_evidence(F.expr(SEEN_AS), F.col("competitor_id") % 2 == 0)
    return t.catalogue.select("competitor_id", "identifier", F.when(new, "FIRST_OBSERVED").otherwise("BASELINE").alias("launch"), F.when(new, evidence).otherwise("BASELINE").alias("evidence"))


#: Words that the test articles get, so that every type and ground of relevance occurs.
ADDED = """coalesce(headline, '') || case news_id % 13 when 0 then ' Black Friday' when 1 then ' unveiled' when 2 then ' a deal' when 3 then ' the showroom' when 4 then ' factory' when 5 then ' at no cost' when 6 then ' retailer of a TV'
    when 7 then ' financing' when 8 then ' air conditioner' else '' end"""
BROAD = f"lower({ADDED} || ' ' || coalesce(body, ''))"


def _has(words):
    return "regexp_matches(x, '(^|[^a-z0-9])(" + "|".join(words) + ")([^a-z0-9]|$)')"


C21_TYPES = f"""case when {_has(['black friday', 'discount', 'sale', 'promotion', 'offer', 'cashback'])} then 'promotion' when {_has(['launched', 'launches', 'launch', 'unveiled', 'introduces', 'introduced', 'new product'])} then 'product launch'
    when {_has(['partnership', 'partnered', 'agreement', 'deal'])} then 'partnership' when {_has(['branch', 'showroom', 'retailer', 'retail', 'distributor', 'distribution'])} then 'distribution'
    when {_has(['manufacturing', 'factory', 'production'])} then 'manufacturing' when {_has(['price', 'prices', 'pricing', 'cost'])} then 'pricing' else 'market development' end"""
C21_SIGNALS = """'discount', 'sale', 'black friday', 'cashback', 'warranty', 'financing', 'lipa later', 'instalment', 'installment', 'free delivery', 'bundle', 'showroom', 'retailer', 'retailers', 'distributor', 'distributors',
    'new branch', 'launch', 'launched', 'partnership', 'sponsorship', 'promotion', 'offer', 'campaign', 'pricing', 'prices', 'price', 'demand', 'manufacturing'"""


@query("c21", f"""select news_id, array_to_string(signals, ',') as signals, news_type, (named or (news_id % 3 = 0 and len(signals) > 0) or (goods and trade)) as relevant from (
    select news_id, list_filter([{C21_SIGNALS}], lambda w: regexp_matches(x, '(^|[^a-z0-9])' || w || '([^a-z0-9]|$)')) as signals, {C21_TYPES} as news_type, {_has(['apache'])} as named,
    {_has(['appliance', 'appliances', 'electronics', 'television', 'tv', 'refrigerator', 'fridge', 'freezer', 'washing machine', 'microwave', 'oven', 'cooker', 'air conditioner', 'soundbar'])} as goods,
    {_has(['retailer', 'retail', 'manufacturer', 'distributor', 'customer', 'consumer', 'product', 'products', 'market', 'brand', 'brands'])} as trade from (select news_id, {BROAD} as x from news))""")
def c21(t):
    title, body = F.expr(ADDED), F.coalesce("body", F.lit(""))
    brands = N.terms_in(F.concat_ws(" ", title, body), ["apache"])
    categories = F.when(F.col("news_id") % 3 == 0, F.array(F.lit("any")))
    rows = t.news.select("news_id", N.market_context(title, body, brands, categories).alias("m"))
    return rows.select("news_id", F.concat_ws(",", "m.signals").alias("signals"), "m.news_type", "m.relevant")


@query("c22", "select observation_id, type, name, category, offer, start_date, end_date, strong from campaign_posts")
def c22(t):
    return t.social.select("observation_id", G.campaign_fields(F.expr(POSTED), F.col("published_date"), CAMPAIGNS).alias("c")).select("observation_id", "c.*")


@query("c23", "select observation_id, case when discount >= 0.09 then 'black_friday' when discount >= 0.06 then 'combo' when discount > 0 then 'sale' end as promotion_type from prices")
def c23(t):
    label = F.expr("case when discount >= 0.09 then 'BLACK FRIDAY combo' when discount >= 0.06 then 'Combo sale' when discount > 0 then 'Sale' else '' end")
    low = F.lower(label)
    kind = T.first_rule([(F.contains(low, F.lit("black friday")), "black_friday"), (F.contains(low, F.lit("combo")), "combo"), (F.contains(low, F.lit("sale")), "sale")]).cast("string")
    return t.prices.select("observation_id", kind.alias("promotion_type"))


ASK = "case conv_id % 5 when 0 then ' active campaigns of nation_7?' when 1 then ' about nation_7 region' when 2 then ' market trend' when 3 then ' facebook posts' else '' end"


@query("c24", f"""select conv_id, turn, case when trim(q) = '' then 'UNSUPPORTED' when contains(q, 'campaign') or contains(q, 'promotion') or contains(q, 'offer') or contains(q, 'sale') then
    case when contains(q, 'active') or contains(q, 'currently running') then 'CAMPAIGNS_ACTIVE' when contains(q, 'upcoming') or contains(q, 'next') or contains(q, 'coming') then 'CAMPAIGNS_UPCOMING' else 'CAMPAIGNS' end
    when contains(q, 'price movement') or contains(q, 'price change') or contains(q, 'price increase') or contains(q, 'price decrease') or contains(q, 'price drop') or contains(q, 'prices change') then 'PRICE_MOVEMENTS'
    when contains(q, 'alert') or contains(q, 'warning') then 'STRATEGIC_ALERTS' when contains(q, 'market') then 'MARKET_TRENDS' when contains(q, 'social') or contains(q, 'facebook') or contains(q, 'instagram') or contains(q, 'post') then 'SOCIAL_EVIDENCE'
    when contains(q, 'catalog') or contains(q, 'products') or contains(q, 'product range') or contains(q, 'sku') or contains(q, 'product launch') then 'PRODUCT_CATALOGUE' when contains(q, 'compare') or contains(q, 'comparison') or contains(q, 'versus') or contains(q, ' vs ') then 'COMPETITOR_COMPARISON' when conv_id % 5 in (0, 1) then 'COMPETITOR_ACTIVITY' else 'UNSUPPORTED' end as intent,
    case conv_id % 5 when 0 then 'N7' when 1 then 'N7 region' end as alias from (select conv_id, turn, trim(regexp_replace(lower(coalesce(question, '') || {ASK}), '\\s+', ' ', 'g')) as q from questions)""")
def c24(t):
    q = F.concat(F.coalesce("question", F.lit("")), F.expr(ASK))
    alias = R.longest_alias(q, {"nation_7": "N7", "nation_7 region": "N7 region"})
    return t.questions.select("conv_id", "turn", R.question_intent(q, alias).alias("intent"), alias.alias("alias"))


ASKED = "coalesce(question, '') || case conv_id % 5 when 0 then ' search the web' when 1 then ' the latest today' else '' end"
INTENT = "case conv_id % 4 when 0 then 'UNKNOWN' when 1 then 'CAMPAIGNS' else 'PRICE_MOVEMENTS' end"
ANSWER, SURETY = "case when turn % 3 = 0 then ' ' else 'some' end", "case conv_id % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end"


@query("c25", f"""select conv_id, turn, case when {" or ".join(f"contains(lower({ASKED}), '{w}')" for w in R.ASKS_FOR_WEB)} then true when {INTENT} = 'UNKNOWN' then true when trim({ANSWER}) = '' then true
    when conv_id % 7 > 2 then false else {SURETY} in ('LOW', 'MEDIUM') end as needs from questions""")
def c25(t):
    needs = R.needs_research(F.expr(ASKED), F.expr(INTENT), F.expr(ANSWER), F.when(F.col("conv_id") % 7 > 2, 5).otherwise(0), F.expr(SURETY))
    return t.questions.select("conv_id", "turn", needs.alias("needs"))


SPEC = """item_name || case product_id % 6 when 0 then ' ' || (9 + 3 * (size % 2)) || 'K Inverter' when 1 then ' 18,000 BTU non-inverter'
    when 2 then ' 25 L or ' || (100 + size) || ' litres, free-standing' when 3 then ' 4 gas burner (60cm) built-in' when 4 then ' 55 inch' else ' 5000 litres' end"""


@query("c26", f"select product_id, {features_sql('t')} from (select product_id, {plain_sql(SPEC)} as t from canonical)")
def c26(t):
    return t.canonical.select("product_id", M.product_features(M.plain_text(F.expr(SPEC))).alias("f")).select("product_id", "f.*")


KIND = """case product_id % 7 when 0 then ' fridge with oven' when 1 then ' front washer' when 2 then ' Split-AC' when 3 then ' deep freezer'
    when 4 then ' smart tv' when 5 then ' gas cooker' else '' end"""


@query("c27", f"select product_id, {family_sql('t')} as family from (select product_id, {plain_sql(f'category || sub_category || item_name || {KIND}')} as t from canonical)")
def c27(t):
    text = M.plain_text(F.concat(F.col("category"), F.col("sub_category"), F.col("item_name"), F.expr(KIND)))
    return t.canonical.select("product_id", M.product_family(text).alias("family"))


@query("c28", r"""select product_id, list_sort(list_filter(['LG', 'SAMSUNG'], lambda b: regexp_matches(t, '\b' || lower(b) || '\b') and upper(brand) <> b)) as conflicts
    from (select product_id, case when product_id % 3 = 0 then 'LG' else brand end as brand, lower(item_name) || case when product_id % 2 = 0 then ' by samsung or lg' else ' lgx' end as t from canonical)""")
def c28(t):
    text = M.plain_text(F.expr("item_name || case when product_id % 2 = 0 then ' by Samsung or LG' else ' LGX' end"))
    return t.canonical.select("product_id", M.brand_conflict(text, F.expr("case when product_id % 3 = 0 then 'LG' else brand end"), ["LG", "SAMSUNG"]).alias("conflicts"))


PAGE_TEXT = "'buy m' || product_id || ' now ' || case when product_id % 3 = 0 then '' else upper(split_part(item_name, ' ', 1)) end || ' and ' || reverse(item_name)"
NAMED_AS = "case when product_id % 4 = 0 then upper(item_name) when product_id % 4 = 1 then item_name || ' series black with extras' when product_id % 4 = 2 then 'new ' || split_part(item_name, ' ', 1) || ' of the season' else 'nothing alike at all' end"


@query("c29", f"""select product_id, model_no <> '' and (contains(page, upper(model_no))) as present, floor((case when len(words) > 0 then len(list_filter(words, lambda w: contains(low, w))) / len(words) else 0.0 end) * 1000 + 0.5) / 1000 as score,
    lower(item_name) = lower(named) or len(list_intersect(own, theirs)) >= case when len(own) <= 3 then 1 else 2 end as alike from (select *, upper({PAGE_TEXT}) as page, lower({PAGE_TEXT}) as low, {NAMED_AS} as named,
    list_filter(regexp_extract_all(lower(item_name), '[a-z0-9]{{3,}}'), lambda w: w not in ('the', 'and', 'with', 'for', 'white', 'black', 'silver', 'grey', 'gray', 'cold')) as words,
    list_distinct(regexp_extract_all(lower({NAMED_AS}), '[a-z0-9]{{3,}}')) as own, list_distinct(regexp_extract_all(lower(item_name), '[a-z0-9]{{3,}}')) as theirs from canonical)""")
def c29(t):
    page, named, name = F.expr(PAGE_TEXT), F.expr(NAMED_AS), F.col("item_name")
    return t.canonical.select("product_id", X.model_present(page, F.col("model_no")).alias("present"), half_up(X.name_score(page, name, ("cold",)), 3).alias("score"), X.names_match(named, name).alias("alike"))

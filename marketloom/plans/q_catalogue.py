"""Queries of product history, position, matching and price positioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as C
from ..operators import matching as M
from ..operators import pairing as A
from .bind import BASELINE, OWN_BRAND, VIEWS
from .registry import query

KNOWN = ["SAMSUNG", "LG"]
#: Words that the test products get, so that every feature, family and conflict occurs.
TITLE = """item_name || case product_id % 9 when 0 then ' 12000 BTU inverter air conditioner' when 1 then ' 9,000 BTU split AC non-inverter'
    when 2 then ' 200 litres fridge' when 3 then ' 60cm gas cooker 4 burner' when 4 then ' 12K split air inverter' when 5 then ' 43 inch smart TV built-in'
    when 6 then ' Fridge 345L and 15 l box, free standing' when 7 then ' 60 cm hood' else '' end || case when product_id % 37 = 0 then ' by Samsung' else '' end"""
SUB = "case sub_category when 'anvil' then 'Cooker Hoods' when 'gizmo' then 'Built-in Ovens' else sub_category end"


def plain_sql(text):
    return rf"trim(regexp_replace(translate(lower({text}), '-_/,()', '      '), '\s+', ' ', 'g'))"


def features_sql(t):
    """Feature columns from the plain text t."""
    num = lambda p: f"try_cast(nullif(regexp_extract({t}, '{p}', 1), '') as integer)"
    k, full, split = (num(p) for p in (rf"\b({M.BTU_THOUSANDS})\s*k\s*(?:btu)?\b", rf"\b((?:{M.BTU_THOUSANDS})000)\s*btu\b", rf"\b({M.BTU_THOUSANDS})\s*000\s*btu\b"))
    gas, burners, width, inches = (num(p) for p in (r"\b([2-6])\s*gas\s*burner", r"\b([2-6])\s*burners?\b", rf"\b({M.WIDTHS})\s*cm\b", rf'\b({M.INCHES})\s*(?:inch|inches|in\b|")'))
    litres = rf"list_transform(regexp_extract_all({t}, '\b(\d{{2,4}})\s*(?:litres?|liters?|lt|l)\b', 1), lambda x: cast(x as integer))"
    return rf"""coalesce({k} * 1000, {full}, {split} * 1000) as btu, list_max(list_filter({litres}, lambda v: v between 20 and 1000)) as litres, coalesce({gas}, {burners}) as burners,
        case when contains({t}, 'non inverter') then 'NON_INVERTER' when regexp_matches({t}, '\binverter\b') then 'INVERTER' end as inverter,
        case when contains({t}, 'built in') then 'BUILT_IN' when regexp_matches({t}, 'free ?standing') then 'FREESTANDING' end as installation, {width} as width_cm, {inches} as tv_inches"""


def family_sql(t):
    has = lambda terms: " or ".join(f"contains({t}, '{w}')" for w in terms)
    return "case " + " ".join(f"when {has(terms)} then '{f}'" for f, terms in M.FAMILIES.items()) + " end"


def both_sql(f):
    return f"case when a.{f} is null or b.{f} is null then 'UNKNOWN' when a.{f} = b.{f} then 'MATCH' else 'CONFLICT' end as {f}"


def conflict_sql(b):
    return rf"(regexp_matches(named, '\b{b.lower()}\b') and upper(trim(brand)) <> '{b}')"


def listed(words):
    return ", ".join(f"'{w}'" for w in words)


MATCHES = " + ".join(f"cast({f} = 'MATCH' as integer)" for f in M.FEATURES)
CLASHES = ", ".join(f"case when {f} = 'CONFLICT' then '{reason}' end" for f, reason in M.HARD.items())
VIEWS |= {
    "own_rival": f"select category, sub_category, count(*) filter (brand = '{OWN_BRAND}') as own, count(*) filter (brand <> '{OWN_BRAND}') as rival from canonical group by 1, 2",
    "titled": f"select * replace ({TITLE} as item_name, {SUB} as sub_category) from canonical",
    "profiled": f"""select product_id, brand, category, sub_category, price, size, {features_sql("ft")}, {family_sql("fam")} as family, {" or ".join(map(conflict_sql, KNOWN))} as conflict,
        list_distinct(list_filter(string_split({plain_sql("item_name")}, ' '), lambda x: length(x) >= 3 and x not in ({listed([*M.STOP_WORDS, 'samsung', 'lg'])}))) as tokens
        from (select *, {plain_sql("concat_ws(' ', item_name, category, sub_category, product_scope)")} as ft, {plain_sql("concat_ws(' ', category, sub_category, item_name)")} as fam,
            {plain_sql("concat_ws(' ', item_name, product_scope)")} as named from titled)""",
    "compared": f"""select a.product_id as own_id, b.product_id as other_id, a.price as own_price, b.price as other_price, a.family as fa, b.family as fb, a.conflict or b.conflict as conflict, lower(trim(a.sub_category)) as sub,
        case when len(a.tokens) > 0 and len(b.tokens) > 0 then len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) else 0.0 end as name_score,
        {", ".join(map(both_sql, M.FEATURES))} from profiled a join profiled b on a.category = b.category and a.sub_category = b.sub_category where a.brand = '{OWN_BRAND}' and b.brand <> '{OWN_BRAND}'""",
    "assessed": f"""select *, case when len(hard) > 0 or conflict then 'NO_DEFENSIBLE_MATCH' when sub in ({listed(M.WIDTH_ALONE)}) and width_cm = 'MATCH' and matches = 1 then 'TYPE_ONLY' when matches >= 2 then 'STRONG_COMPARABLE'
        when matches >= 1 and fa in ({listed(M.DECISIVE)}) then 'COMPARABLE' when fa is not null and fb is not null then 'TYPE_ONLY' else 'NO_DEFENSIBLE_MATCH' end as match_level
        from (select *, {MATCHES} as matches, list_filter([case when fa <> fb then 'PRODUCT_FAMILY_CONFLICT:' || fa || '!=' || fb end, {CLASHES}], lambda x: x is not null) as hard from compared)""",
}


def titled(t):
    return t.canonical.withColumns({"item_name": F.expr(TITLE), "sub_category": F.expr(SUB)})


def assessed(t, *keep):
    p = M.assessed_levels(titled(t), OWN_BRAND, KNOWN, ["product_id", *keep])
    return p.withColumnsRenamed({"own_product_id": "own_id", "other_product_id": "other_id"})


@query("h1", f"select competitor_id, identifier, case when first_seen_date > date '{BASELINE}' then 'NEW_PRODUCT_CANDIDATE' else 'BASELINE_PRODUCT' end as status from catalogue")
def h1(t):
    return t.catalogue.select("competitor_id", "identifier", C.new_product_status(F.col("first_seen_date"), BASELINE).alias("status"))


QUALITY = "case when model = '' then 'missing' when length(model) < 4 or regexp_matches(model, '^[0-9]+$') then 'weak' else 'reliable' end"


@query("h2", f"""select competitor_id, identifier, case when first_seen_date <= date '{BASELINE}' then 'BASELINE_MODEL' when q = 'reliable' then 'NEW_MODEL_CANDIDATE' when q = 'weak' then 'MODEL_IDENTIFIER_WEAK' else 'MODEL_IDENTIFIER_MISSING' end as status
    from (select *, {QUALITY} as q from (select * replace (case when model <> '' and cast(identifier as bigint) % 3 = 0 then 'MX' || model else model end as model) from catalogue))""")
def h2(t):
    c = t.catalogue.withColumn("model", F.expr("case when model <> '' and cast(identifier as bigint) % 3 = 0 then 'MX' || model else model end"))
    return c.select("competitor_id", "identifier", C.new_model_status(F.col("first_seen_date"), C.model_quality(F.col("model")), BASELINE).alias("status"))


@query("h3", "select least(min(first_seen_date), min(last_seen_date)) as first_date, greatest(max(first_seen_date), max(last_seen_date)) as last_date from catalogue")
def h3(t):
    return C.date_range(t.catalogue)


DATED = """select competitor_id, identifier, case when cast(identifier as integer) % 23 <> 0 then first_seen_date end as first_seen_date,
    case when cast(identifier as integer) % 29 <> 0 then last_seen_date end as last_seen_date from catalogue"""


@query("h4", f"""select competitor_id, identifier, cast(last_seen_date - first_seen_date as integer) as span_days, cast((select max(last_seen_date) from ({DATED})) - last_seen_date as integer) as gap_days,
    case when last_seen_date is null or first_seen_date is null or last_seen_date - first_seen_date < 7 then 'INSUFFICIENT_HISTORY'
    when (select max(last_seen_date) from ({DATED})) - last_seen_date >= 7 then 'POSSIBLE_DISCONTINUATION' else 'CURRENTLY_OBSERVED' end as presence from ({DATED})""")
def h4(t):
    known = lambda c, n: F.when(F.col("identifier").cast("int") % n != 0, F.col(c))
    dated = t.catalogue.withColumns({"first_seen_date": known("first_seen_date", 23), "last_seen_date": known("last_seen_date", 29)})
    return C.historical_presence(dated, ["competitor_id", "identifier"])


@query("h5", f"select competitor_id, identifier from catalogue where first_seen_date > date '{BASELINE}' and model <> ''")
def h5(t):
    c = t.catalogue.withColumn("status", C.new_product_status(F.col("first_seen_date"), BASELINE))
    return c.where("status = 'NEW_PRODUCT_CANDIDATE' and model <> ''").select("competitor_id", "identifier")


POSITION = "case when own > 0 and rival > 0 then 'SHARED' when own > 0 then 'OWN_ONLY' when rival > 0 then 'COMPETITOR_ONLY' else 'NO_COVERAGE' end"


@query("g1", f"select category, sub_category, {POSITION} as position from own_rival union all select category, null, {POSITION} from (select category, sum(own) as own, sum(rival) as rival from own_rival group by 1)")
def g1(t):
    fine = C.own_rival(t.canonical, OWN_BRAND)
    coarse = C.own_rival(t.canonical, OWN_BRAND, ("category",)).withColumn("sub_category", F.lit(None).cast("string"))
    return fine.unionByName(coarse).select("category", "sub_category", C.position(F.col("own"), F.col("rival")).alias("position"))


GAPS = f"""select category, sub_category, own, rival, coverage, breadth, case when coverage in ('OWN_ONLY', 'COMPETITOR_ONLY') then 'VALIDATE_BEFORE_GAP_CLAIM' else 'COMPARABLE_COVERAGE' end as assessment
    from (select *, {POSITION} as coverage, case when own > 0 and rival > 0 then case when own > rival then 'OWN_CATALOGUE_BREADTH_HIGHER' when own < rival then 'COMPETITOR_CATALOGUE_BREADTH_HIGHER' else 'SIMILAR_CATALOGUE_BREADTH' end when own > 0 then 'OWN_UNIQUE_COVERAGE' when rival > 0 then 'COMPETITOR_COVERAGE_NOT_IN_OWN_CATALOGUE' else 'NO_COVERAGE' end as breadth from own_rival)"""


@query("g2", GAPS)
def g2(t):
    return C.gap_signals(C.own_rival(t.canonical, OWN_BRAND))


@query("g3", f"select breadth, count(*) as n, cast(sum(rival) as bigint) as rival_products from ({GAPS}) where breadth in ('COMPETITOR_COVERAGE_NOT_IN_OWN_CATALOGUE', 'COMPETITOR_CATALOGUE_BREADTH_HIGHER') group by 1")
def g3(t):
    g = C.gap_signals(C.own_rival(t.canonical, OWN_BRAND)).where(F.col("breadth").isin("COMPETITOR_COVERAGE_NOT_IN_OWN_CATALOGUE", "COMPETITOR_CATALOGUE_BREADTH_HIGHER"))
    return g.groupBy("breadth").agg(F.count("*").alias("n"), F.sum("rival").alias("rival_products"))


@query("g4", f"""select 'products' as metric, count(*) as value from canonical union all select 'own products', count(*) from canonical where brand = '{OWN_BRAND}' union all select 'brands', count(distinct brand) from canonical union all select 'categories', count(distinct category) from canonical""")
def g4(t):
    one = t.canonical.agg(F.count("*").alias("products"), F.count_if(F.col("brand") == OWN_BRAND).alias("own products"), F.count_distinct("brand").alias("brands"), F.count_distinct("category").alias("categories"))
    return one.unpivot([], ["products", "own products", "brands", "categories"], "metric", "value")


@query("g5", f"select category, sub_category, count(*) as rival_products from canonical c where brand <> '{OWN_BRAND}' and not exists (select 1 from canonical o where o.brand = '{OWN_BRAND}' and o.category = c.category and o.sub_category = c.sub_category and o.size > 40) group by 1, 2")
def g5(t):
    keys = ["category", "sub_category"]
    own = t.canonical.where((F.col("brand") == OWN_BRAND) & (F.col("size") > 40)).select(*keys).distinct()
    return t.canonical.where(F.col("brand") != OWN_BRAND).join(own, keys, "left_anti").groupBy(*keys).agg(F.count("*").alias("rival_products"))


@query("g6", f"""select category, sub_category, count(*) filter (brand = '{OWN_BRAND}') as own, count(*) filter (brand <> '{OWN_BRAND}') as rival, count(distinct case when model_no <> '' then model_no end) as identifiers
    from canonical group by 1, 2 having count(*) filter (brand = '{OWN_BRAND}') > 0 and count(*) filter (brand <> '{OWN_BRAND}') > 0""")
def g6(t):
    own = F.col("brand") == OWN_BRAND
    g = t.canonical.groupBy("category", "sub_category").agg(F.count_if(own).alias("own"), F.count_if(~own).alias("rival"), F.count_distinct(F.when(F.col("model_no") != "", F.col("model_no"))).alias("identifiers"))
    return g.where("own > 0 and rival > 0")


@query("x1", f"select own_id, other_id, {', '.join(M.FEATURES)} from compared")
def x1(t):
    return assessed(t).select("own_id", "other_id", *M.FEATURES)


@query("x2", "select own_id, other_id, hard from assessed")
def x2(t):
    return assessed(t).select("own_id", "other_id", "hard")


@query("x3", "select own_id, other_id, match_level from assessed")
def x3(t):
    return assessed(t).select("own_id", "other_id", "match_level")


@query("x4", "select match_level, count(*) as pairs, count(distinct own_id) as own_products, count(distinct other_id) as other_products from assessed group by 1")
def x4(t):
    return M.level_counts(titled(t), OWN_BRAND, KNOWN)


RANKED = """select own_id, other_id, match_level, row_number() over (partition by own_id
    order by case match_level when 'STRONG_COMPARABLE' then 4 when 'COMPARABLE' then 3 when 'TYPE_ONLY' then 2 else 1 end desc, matches desc, name_score desc, other_id) as rn from assessed"""


@query("x5", f"""select c.product_id as own_id, r.other_id, coalesce(r.match_level, 'NO_DEFENSIBLE_MATCH') as match_level from canonical c
    left join (select * from ({RANKED}) where rn = 1 and match_level <> 'NO_DEFENSIBLE_MATCH') r on c.product_id = r.own_id where c.brand = '{OWN_BRAND}'""")
def x5(t):
    own = t.canonical.where(F.col("brand") == OWN_BRAND).select(F.col("product_id").alias("own_id"))
    out = own.join(A.best_matches(titled(t), OWN_BRAND, KNOWN), "own_id", "left")
    return out.select("own_id", F.col("best_id").alias("other_id"), F.coalesce("best_level", F.lit("NO_DEFENSIBLE_MATCH")).alias("match_level"))


@query("x6", f"select own_id, other_id, match_level from ({RANKED}) where match_level = 'NO_DEFENSIBLE_MATCH' or (match_level = 'TYPE_ONLY' and rn > 1)")
def x6(t):
    weak = F.col("match_level").isin("TYPE_ONLY", "NO_DEFENSIBLE_MATCH")
    best = A.best_matches(titled(t), OWN_BRAND, KNOWN).select(F.col("own_id").alias("product_id"), "best_id")
    a = M.assessed_levels(titled(t).join(best, "product_id", "left"), OWN_BRAND, KNOWN, ["product_id", "best_id"])
    rest = a.where(weak & (F.col("own_best_id").isNull() | (F.col("other_product_id") != F.col("own_best_id"))))
    return rest.select(F.col("own_product_id").alias("own_id"), F.col("other_product_id").alias("other_id"), "match_level")


@query("x7", """select model, case when s = 1 and r <= 1 then if(official, 'VERIFIED_OFFICIAL_SALE', 'VERIFIED_RETAIL_PROMOTIONAL_PRICE')
    when r = 1 and s = 0 then if(official, 'VERIFIED_OFFICIAL_PRICE', 'VERIFIED_RETAIL_PRICE') when n = 1 then if(official, 'VERIFIED_OFFICIAL_PRICE', 'VERIFIED_RETAIL_PRICE')
    when n > 1 then 'MULTIPLE_PRICE_CANDIDATES' when official then 'PRICE_NOT_EXPOSED_OFFICIAL_SOURCE' else 'PRICE_NOT_FOUND' end as verdict from
    (select model, count(distinct p) filter (discount <= 0.05) as r, count(distinct p) filter (discount > 0.05) as s, count(distinct p) as n, min(line_status) = 'F' as official
    from (select *, case when cast(model as integer) % 13 <> 0 then floor(price_kes / 900) end as p from prices) group by 1)""")
def x7(t):
    p = F.when(F.col("model").cast("int") % 13 != 0, F.floor(F.col("price_kes") / 900))
    sale, seen = F.col("discount") > 0.05, F.collect_set(p).alias("n")
    g = t.prices.groupBy("model").agg(F.collect_set(F.when(~sale, p)).alias("r"), F.collect_set(F.when(sale, p)).alias("s"), seen, F.min("line_status").alias("status"))
    source = F.when(F.col("status") == "F", "BRAND_OFFICIAL").otherwise("RETAIL")
    return g.select("model", M.evidence_verdict(F.col("r"), F.col("s"), F.col("n"), source).alias("verdict"))


def defensible(t):
    return A.defensible_pairs(titled(t), OWN_BRAND, KNOWN, ["price"])


def positioned(t):
    """Only defensible pairs are positioned."""
    state = lambda c: F.when(F.col(c) % 3 == 0, "MULTIPLE_PRICES").when(F.col(c) % 5 == 0, "VERIFIED_RETAIL_PROMOTIONAL_PRICE").otherwise("VERIFIED_RETAIL_PRICE")
    rows = defensible(t)
    return M.price_positioning(rows.withColumns({"own_status": state("own_id"), "other_status": state("other_id")}))


VIEWS["defensible"] = "select * from assessed where match_level in ('STRONG_COMPARABLE', 'COMPARABLE')"
VIEWS["positioned"] = """select own_id, other_id, st as positioning_status, case when st = 'PRICE_COMPARISON_AVAILABLE' then floor((own_price - other_price) * 100 + 0.5) / 100 end as difference,
    case when st = 'PRICE_COMPARISON_AVAILABLE' then floor((own_price - other_price) / other_price * 100 * 100 + 0.5) / 100 end as premium_pct, case when st = 'PRICE_COMPARISON_AVAILABLE' then case when own_price > other_price then 'PREMIUM' when own_price < other_price then 'DISCOUNT' else 'PARITY' end end as position,
    own_price, other_price from (select *, case when own_id % 3 = 0 or other_id % 3 = 0 then 'PRICE_COMPARISON_NOT_AVAILABLE' when not (own_price > 0 and other_price > 0) then 'PRICE_COMPARISON_NOT_AVAILABLE' when (own_id % 5 = 0) <> (other_id % 5 = 0) then 'PRICE_COMPARISON_REQUIRES_PROMOTION_ALIGNMENT' else 'PRICE_COMPARISON_AVAILABLE' end as st from defensible)"""


@query("x8", "select own_id, other_id, positioning_status, difference, premium_pct, position from positioned")
def x8(t):
    return positioned(t).select("own_id", "other_id", "positioning_status", "difference", "premium_pct", "position")


@query("x9", """select model, case when n = 1 then p end as price, n as n_prices, case when n = 1 then 'ONE_PRICE' when n > 1 then 'MULTIPLE_PRICES' else 'NO_PRICE' end as verdict from (select model, count(distinct cast(floor(price_kes / 400) as bigint)) as n, min(cast(floor(price_kes / 400) as bigint)) as p from prices group by 1)""")
def x9(t):
    return M.one_price(t.prices.withColumn("price", F.floor(F.col("price_kes") / 400)), "model")


@query("x10", "select own_id, other_id, 'own' as side, own_price as price from positioned where positioning_status <> 'PRICE_COMPARISON_AVAILABLE' union all select own_id, other_id, 'competitor', other_price from positioned where positioning_status <> 'PRICE_COMPARISON_AVAILABLE'")
def x10(t):
    return M.two_sides(positioned(t).where("positioning_status <> 'PRICE_COMPARISON_AVAILABLE'"), ["own_id", "other_id"], {"own": ["own_price"], "competitor": ["other_price"]}, ["price"])


@query("x11", "select own_id, other_id, match_level, 'own' as side, own_id as product_id, own_price as price from defensible union all select own_id, other_id, match_level, 'competitor', other_id, other_price from defensible")
def x11(t):
    return M.two_sides(defensible(t), ["own_id", "other_id", "match_level"], {"own": ["own_id", "own_price"], "competitor": ["other_id", "other_price"]}, ["product_id", "price"])


@query("x12", "select own_id, other_id, match_level from assessed where match_level in ('STRONG_COMPARABLE', 'COMPARABLE')")
def x12(t):
    return defensible(t).select("own_id", "other_id", "match_level")



"""News classification, attribution and routing. Term lists are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dictionary import found_in, found_in_lists, labels_in


def terms_in(c: Column, terms: list[str]) -> Column:
    """The terms that stand in the text as whole words or phrases, in list order."""
    return found_in(c, terms)


def categories_in(c: Column, rules: dict[str, list[str]], guard: str | None = None) -> Column:
    """Categories with a term in the text; phrases that match guard are cut out first."""
    return labels_in(F.regexp_replace(F.lower(c), guard, " ") if guard else c, rules)


def attribute(entities: Column, headline: Column, brands: list[str]) -> Column:
    """The tracked brand of an article: the first of its entities that is a brand and stands in the headline, else the first
    that is a brand; null if none."""
    known = F.lit(sorted({b.lower() for b in brands}))
    named = F.filter(F.transform(entities, lambda e: F.trim(e)), lambda e: (e != "") & F.array_contains(known, F.lower(e)))
    shown = F.filter(named, lambda e: F.contains(F.lower(F.coalesce(headline, F.lit(""))), F.lower(e)))
    return F.coalesce(F.get(shown, F.lit(0)), F.get(named, F.lit(0)))


#: Words that tell what an article is about.
PARTNERSHIP = ["partnership", "partnerships", "partner", "partners", "collaboration", "collaborates", "alliance", "joint venture", "strategic partnership"]
DISTRIBUTION = [
    "distributor", "distribution", "retailer", "retail partner", "marketplace", "digital store", "online store", "e-commerce", "ecommerce", "direct to consumer",
    "direct-to-consumer", "outlet", "sales channel", "distribution channel",
]
EXPANSION = [
    "expands", "expanded", "expansion", "new store", "new outlet", "new showroom", "new facility", "new plant", "factory", "assembly plant", "local assembly",
    "manufacturing plant", "enters", "entered", "new market", "footprint",
]
COMPANY = [
    "launch", "launches", "launched", "introduces", "introduced", "unveils", "unveiled", "expands", "expansion", "partnership", "partners", "investment", "assembly",
    "manufacturing", "factory", "store", "showroom", "roadshow", "campaign", "promotion", "sale", "discount", "price", "pricing", "service", "digital store",
    "direct to consumer", "local plant", "local assembly", "new facility", "new outlet", "opens", "opened", "opening", "rolls out", "rolled out", "introducing",
]
MARKET = [
    "market", "industry", "demand", "consumers", "consumer demand", "retail", "sales", "homes", "households", "electrification", "investment", "manufacturing",
    "technology", "adoption", "growth",
]
#: Types in order of precedence: name, words (None: any text), whether a tracked entity must be named.
TYPES = [
    ("PARTNERSHIP", PARTNERSHIP, True), ("DISTRIBUTION", DISTRIBUTION, True), ("EXPANSION", EXPANSION, True), ("COMPANY_DEVELOPMENT", COMPANY, True),
    ("MARKET_DEVELOPMENT", MARKET, False), ("COMPANY_DEVELOPMENT", None, True),
]


def subject_text(title: Column, body: Column, lead: int = 800) -> Column:
    """The headline and the opening characters of the body, normalised."""
    clean = lambda c: T.squeeze(F.translate(F.lower(F.coalesce(c, F.lit(""))), "\u2019\u2018\u201c\u201d\u2013\u2014", "''\"\"--"))
    return F.trim(F.concat_ws(" ", clean(title), F.substring(clean(body), 1, lead)))


def news_type(subject: Column, entities: Column, types: list[tuple[str, list[str] | None, bool]] = TYPES, otherwise: str = "INDUSTRY_NEWS") -> Column:
    """The first type whose words the subject text has and whose entity condition holds."""
    lists = {str(i): w for i, (_, w, _) in enumerate(types) if w}
    rules = lambda found: T.first_rule([(
        (F.size(entities) > 0 if named else F.lit(True)) & (F.array_contains(found, str(i)) if w else F.lit(True)), k
    ) for i, (k, w, named) in enumerate(types)], otherwise)
    return F.transform(F.array(labels_in(subject, lists)), rules)[0]


def scope(entities: Column, products: Column, local: Column, kind: Column) -> Column:
    """struct(status, reason) from the tracked entities, products and local terms of an article and its type."""
    make = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    some = lambda c: F.size(c) > 0
    return (
        F.when(some(entities) & (some(local) | some(products)), make("IN_SCOPE", "TRACKED_ENTITY_WITH_MARKET_ACTIVITY"))
        .when(some(entities), make("IN_SCOPE", "TRACKED_ENTITY"))
        .when(some(products) & some(local), make("IN_SCOPE", "LOCAL_PRODUCT_MARKET"))
        .when((kind == "MARKET_DEVELOPMENT") & some(local), make("REVIEW", "LOCAL_MARKET_NO_PRODUCT_SIGNAL"))
        .when(some(local), make("REVIEW", "LOCAL_REFERENCE_REQUIRES_MARKET_RELEVANCE_REVIEW"))
        .otherwise(make("OUT_OF_SCOPE", "NO_RELEVANT_MARKET_SIGNAL"))
    )


def confidence(title: Column, body: Column, dated: Column, url: Column, entities: Column, products: Column, status: Column) -> Column:
    """HIGH, MEDIUM or LOW from summed evidence; HIGH also needs a body, a web address, an entity or product, and scope."""
    one = lambda c, n=1: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    n, web = F.length(F.coalesce(body, F.lit(""))), F.coalesce(F.lower(url).rlike("^https?://"), F.lit(False))
    named, shown = F.size(entities) > 0, F.size(products) > 0
    size = F.when(n >= 1000, 2).when(n >= 500, 1).otherwise(0)
    scoped = F.when(status == "IN_SCOPE", 1).when(status == "REVIEW", -1).otherwise(0)
    points = one(F.trim(title) != "") + size + one(dated) + one(web) + one(named, 2) + one(shown) + scoped
    high = (points >= 9) & (n >= 500) & web & (named | shown) & (status == "IN_SCOPE")
    return T.first_rule([(high, "HIGH"), (points >= 6, "MEDIUM")], "LOW")


#: Words that make a candidate article worth reading.
TELLING = ["launch", "launched", "assembly", "investment", "expansion", "partnership", "distribution", "market", "sales", "promotion"]


def priority_score(local: Column, entities: Column, products: Column, publisher: Column, publishers: list[str], text: Column, published: Column, as_of: str, telling: list[str] = TELLING) -> Column:
    """Priority of a candidate article: 5 a local term, 10 an entity, 3 a product, 8 for a known publisher, 5 for a telling word,
    5 if published within two days, 3 within a week."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    age = F.datediff(F.lit(as_of).cast("date"), published)
    known = T.contains_any(F.lower(F.coalesce(publisher, F.lit(""))), [p.lower() for p in publishers])
    told = T.contains_any(F.lower(F.coalesce(text, F.lit(""))), telling)
    return (5 * n(local) + 10 * n(entities) + 3 * n(products) + F.when(known, 8).otherwise(0) + F.when(told, 5).otherwise(0) + F.when(age <= 2, 5).when(age <= 7, 3).otherwise(0)).cast("int")


def title_quality(c: Column) -> Column:
    """Points of a title: 5 for a usual length, less 4 for each place where a small letter runs into a capital one, 2 for each
    common word run into the next, 1 for a bar; a blank title has -1000."""
    title = T.squeeze(F.coalesce(c, F.lit("")))
    glued = F.regexp_count(title, F.lit("(?<=[a-z])(?=[A-Z])"))
    run_on = F.regexp_count(title, F.lit(r"(?<![\p{L}\p{N}_])(?:the|a|an|and|or|to|of|in|on|for|with|from|into|that|how|is|are|can|will|you|your|our|their)[a-z]{4,}"))
    points = F.when(F.length(title).between(20, 180), 5.0).otherwise(0.0) - 4.0 * glued - 2.0 * run_on - F.when(F.contains(title, F.lit("|")), 1.0).otherwise(0.0)
    return F.when(title == "", -1000.0).otherwise(points)


def text_quality(c: Column) -> Column:
    """Points for length and sentence ends less points for glued words, markup and decoding damage."""
    n = F.length(c)
    damage = F.regexp_count(c, F.lit(r"[a-z][A-Z]")) * 2 + F.regexp_count(c, F.lit(r"<[^>]+>")) * 5 + F.regexp_count(c, F.lit("â€|Ã.")) * 5
    return F.when(n >= 1500, 40).when(n >= 600, 30).when(n >= 200, 15).otherwise(0) + F.least(F.regexp_count(c, F.lit(r"[.!?](?: |\z)")), F.lit(20)) - F.least(damage, F.lit(60))


def best_text(candidates: DataFrame, key: str, text: str, tie: str, least: int = 0) -> DataFrame:
    """The candidate text of best quality and enough length of each key."""
    ok = candidates.where(F.length(text) >= least).withColumn("quality", text_quality(F.col(text)))
    return ok.groupBy(key).agg(F.max_by(F.struct(text, "quality"), F.struct("quality", F.length(text), -F.col(tie))).alias("r")).select(key, f"r.{text}", "r.quality")


def route(df: DataFrame, stored: DataFrame) -> DataFrame:
    """state of each record: skipped unless in scope, stored already (same id or url identity), finding or market news."""
    seen = stored.select("identity").distinct().withColumn("seen_url", F.lit(True))
    ids = stored.select("news_id").distinct().withColumn("seen_id", F.lit(True))
    j = df.join(seen, "identity", "left").join(ids, "news_id", "left")
    state = T.first_rule([(~F.coalesce(F.col("scope_status") == "IN_SCOPE", F.lit(False)), "skipped"), (F.col("seen_url") | F.col("seen_id"), "duplicate"), (F.col("entity").isNotNull(), "finding")], "market_news")
    return j.withColumn("state", state)


#: Signals of a market, types by the words of a whole text in order, words of products and of trade.
SIGNALS = [
    "discount", "sale", "black friday", "cashback", "warranty", "financing", "lipa later", "instalment", "installment", "free delivery", "bundle", "showroom",
    "retailer", "retailers", "distributor", "distributors", "new branch", "launch", "launched", "partnership", "sponsorship", "promotion", "offer", "campaign",
    "pricing", "prices", "price", "demand", "manufacturing",
]
WHOLE_TEXT_TYPES = {
    "promotion": ["black friday", "discount", "sale", "promotion", "offer", "cashback"],
    "product launch": ["launched", "launches", "launch", "unveiled", "introduces", "introduced", "new product"],
    "partnership": ["partnership", "partnered", "agreement", "deal"],
    "distribution": ["branch", "showroom", "retailer", "retail", "distributor", "distribution"],
    "manufacturing": ["manufacturing", "factory", "production"],
    "pricing": ["price", "prices", "pricing", "cost"],
}
PRODUCT_WORDS = [
    "appliance", "appliances", "electronics", "television", "tv", "refrigerator", "fridge", "freezer", "washing machine", "microwave", "oven", "cooker",
    "air conditioner", "soundbar", "home appliance", "consumer electronics",
]
TRADE_WORDS = ["retailer", "retail", "manufacturer", "distributor", "customer", "consumer", "product", "products", "market", "brand", "brands"]


def market_context(title: Column, body: Column, brands: Column, categories: Column, signals: list[str] = SIGNALS, types: dict[str, list[str]] = WHOLE_TEXT_TYPES,
                   products: list[str] = PRODUCT_WORDS, trade: list[str] = TRADE_WORDS) -> Column:
    """struct(signals array, news_type, relevant) of an article, all its words looked up in one pass over the text.

    An article is relevant if it names a brand (brands, an array), or has a category (categories, an array) and a signal, or words of
    products and of trade; a blank one never is. The type is the first of types with a word in the text, else market development."""
    whole = F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))
    found = found_in_lists(whole, {"signals": signals, "products": products, "trade": trade, **{f"type {k}": v for k, v in types.items()}}, once=True)
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return F.transform(F.array(F.struct(found.alias("f"), (whole != "").alias("any"), some(brands).alias("b"), some(categories).alias("c"))), lambda x: F.struct(
        x["f"]["signals"].alias("signals"),
        T.first_rule([(F.size(x["f"][f"type {k}"]) > 0, k) for k in types], "market development").alias("news_type"),
        (x["any"] & (x["b"] | (x["c"] & (F.size(x["f"]["signals"]) > 0)) | ((F.size(x["f"]["products"]) > 0) & (F.size(x["f"]["trade"]) > 0)))).alias("relevant"),
    ))[0]

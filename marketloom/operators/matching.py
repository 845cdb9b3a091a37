"""Model matching and price positioning."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import overwrite, scratch
from .blocks import block_pairs, judged_pairs, judged_signatures, sides, signed, spread

FEATURES = ["btu", "litres", "burners", "inverter", "installation", "width_cm", "tv_inches"]
#: A conflict in one of these features rules a pair out; litres and width only fail to support it.
HARD = {
    "btu": "BTU_CAPACITY_CONFLICT",
    "inverter": "INVERTER_CONFIGURATION_CONFLICT",
    "burners": "BURNER_COUNT_CONFLICT",
    "installation": "INSTALLATION_CONFIGURATION_CONFLICT",
    "tv_inches": "TV_SCREEN_SIZE_CONFLICT",
}
#: Product families with their terms; the first family with a term in the text is taken.
FAMILIES = {
    "AIR_CONDITIONER": ["air conditioner", "air conditioning", "split ac", "split air", "inverter ac"],
    "OVEN": ["oven"],
    "COOKER_STOVE": ["cooker", "stove", "gas burner"],
    "REFRIGERATOR": ["refrigerator", "fridge", "double door", "side by side", "top mount", "bottom mount", "freezer"],
    "TV": ["television", "smart tv", "android tv", "qled", "oled", "led tv", "tv "],
    "WASHING_MACHINE": ["washing machine", "washer"],
    "MICROWAVE": ["microwave"],
    "BLENDER": ["blender"],
    "AIR_FRYER": ["air fryer"],
    "KETTLE": ["kettle"],
}
#: Families in which one matching feature decides, sub-categories in which width alone does not count.
DECISIVE = ["AIR_CONDITIONER", "REFRIGERATOR", "TV", "WASHING_MACHINE", "COOKER_STOVE"]
WIDTH_ALONE = ["built-in ovens", "cooker hoods"]
#: Words that say nothing about a product; the brands that are compared are left out besides.
STOP_WORDS = "the and with for new model series black white silver stainless steel appliance appliances".split()
#: Sizes that stand for a feature.
BTU_THOUSANDS, WIDTHS = "9|12|18|24", "50|55|60|70|75|80|90"
INCHES = "24|32|40|42|43|50|55|58|60|65|70|75|85|86|98"


def plain_text(*parts: Column) -> Column:
    """Parts in lower case, separators as blanks, one blank between words."""
    text = F.translate(F.lower(F.concat_ws(" ", *parts)), "-_/,()", "      ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def telling_tokens(c: Column, stop: list[str], least: int = 3) -> Column:
    """Distinct words of some length outside a stop list."""
    return F.array_distinct(F.filter(F.split(plain_text(c), " "), lambda t: (F.length(t) >= least) & ~t.isin(*stop)))


def token_jaccard(x: Column, y: Column) -> Column:
    """Shared share of two token arrays; 0 if one has none."""
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both / (F.size(x) + F.size(y) - both)).otherwise(F.lit(0.0))


def product_features(text: Column) -> Column:
    """struct of FEATURES from plain text, null where not named: BTU as thousands or written out, the largest litres from
    20 to 1000, two to six burners, inverter or not, installation, a usual width, a usual screen size."""
    num = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("int")  # noqa: E731 - a failing cast of '' is dear
    btu = F.coalesce(
        num(rf"\b({BTU_THOUSANDS})\s*k\s*(?:btu)?\b") * 1000,
        num(rf"\b((?:{BTU_THOUSANDS})000)\s*btu\b"),
        num(rf"\b({BTU_THOUSANDS})\s*000\s*btu\b") * 1000,
    )
    litres = F.regexp_extract_all(text, F.lit(r"\b(\d{2,4})\s*(?:litres?|liters?|lt|l)\b"), F.lit(1))
    litres = F.filter(F.transform(litres, lambda x: x.try_cast("int")), lambda v: v.between(20, 1000))
    inverter = F.when(F.contains(text, F.lit("non inverter")), "NON_INVERTER").when(text.rlike(r"\binverter\b"), "INVERTER")
    installed = F.when(F.contains(text, F.lit("built in")), "BUILT_IN").when(text.rlike("free ?standing"), "FREESTANDING")
    return F.struct(
        btu.alias("btu"),
        F.array_max(litres).alias("litres"),
        F.coalesce(num(r"\b([2-6])\s*gas\s*burner"), num(r"\b([2-6])\s*burners?\b")).alias("burners"),
        inverter.alias("inverter"),
        installed.alias("installation"),
        num(rf"\b({WIDTHS})\s*cm\b").alias("width_cm"),
        num(rf"\b({INCHES})\s*(?:inch|inches|in\b|\")").alias("tv_inches"),
    )


def product_family(text: Column) -> Column:
    """First family with a term in plain text of category, sub-category and name."""
    return T.first_rule([(T.contains_any(text, terms), f) for f, terms in FAMILIES.items()]).cast("string")


def compare_features(a: Column, b: Column) -> Column:
    """struct of UNKNOWN, MATCH or CONFLICT for each feature."""
    one = lambda f: F.when(a[f].isNull() | b[f].isNull(), "UNKNOWN").when(a[f] == b[f], "MATCH").otherwise("CONFLICT").alias(f)
    return F.struct(*map(one, FEATURES))


def brand_conflict(text: Column, brand: Column, brands: list[str]) -> Column:
    """Other known brands that a row's plain text names as a word, sorted."""
    named = lambda b: text.rlike(rf"\b{re.escape(b.lower())}\b") & (F.upper(F.trim(brand)) != b.upper())
    return F.array_sort(F.array_compact(F.array(*(F.when(named(b), F.lit(b)) for b in brands)).cast("array<string>")))


def profile(df: DataFrame, brands: list[str], keep: list[str], keys: tuple[str, ...]) -> DataFrame:
    """What a pair needs of each product, computed once: keys, brand, kept columns, features, family, conflicts, tokens."""
    scope = F.col("product_scope") if "product_scope" in df.columns else F.lit("")
    df = df.withColumns({
        "_text": plain_text(F.col("item_name"), F.col("category"), F.col("sub_category"), scope),
        "_kind": plain_text(F.col("category"), F.col("sub_category"), F.col("item_name")),
        "_named": plain_text(F.col("item_name"), scope),
    })
    return df.select(
        *keys, "brand", *(c for c in keep if c not in (*keys, "brand")),
        product_features(F.col("_text")).alias("features"),
        product_family(F.col("_kind")).alias("family"),
        (F.size(brand_conflict(F.col("_named"), F.col("brand"), brands)) > 0).alias("brand_conflict"),
        telling_tokens(F.col("item_name"), [*STOP_WORDS, *(b.lower() for b in brands)]).alias("tokens"),
    )


def judge(p: DataFrame, narrow: Column) -> DataFrame:
    """Adds features (their comparison), hard (reasons), matches and match_level to pairs of structs own and other, which hold
    features, family and brand_conflict. narrow: width alone does not count.

    Precedence: hard conflict, another brand named on either side, width alone where it does not count, two matches,
    one match in a decisive family, known families, none."""
    p = p.withColumn("features", compare_features(F.col("own.features"), F.col("other.features")))
    one, two = F.col("own.family"), F.col("other.family")
    family = F.when(one != two, F.concat(F.lit("PRODUCT_FAMILY_CONFLICT:"), one, F.lit("!="), two))
    conflicts = (F.when(F.col(f"features.{f}") == "CONFLICT", F.lit(reason)) for f, reason in HARD.items())
    matched = lambda fs: sum((F.when(F.col(f"features.{f}") == "MATCH", 1).otherwise(0) for f in fs), F.lit(0))
    p = p.withColumns({"hard": F.array_compact(F.array(family, *conflicts)), "matches": matched(FEATURES)})
    width_alone = narrow & (F.col("features.width_cm") == "MATCH") & (F.col("matches") == 1)
    level = T.first_rule([
        (F.size("hard") > 0, "NO_DEFENSIBLE_MATCH"),
        (F.col("own.brand_conflict") | F.col("other.brand_conflict"), "NO_DEFENSIBLE_MATCH"),
        (width_alone, "TYPE_ONLY"),
        (F.col("matches") >= 2, "STRONG_COMPARABLE"),
        ((F.col("matches") >= 1) & F.coalesce(one.isin(*DECISIVE), F.lit(False)), "COMPARABLE"),
        (one.isNotNull() & two.isNotNull(), "TYPE_ONLY"),
    ], "NO_DEFENSIBLE_MATCH")
    return p.withColumn("match_level", level)


def narrow_category(sub_category: Column) -> Column:
    return F.coalesce(F.lower(F.trim(sub_category)).isin(*WIDTH_ALONE), F.lit(False))


def assess_pairs(df: DataFrame, own: str, brands: list[str], keep: list[str], keys: tuple[str, ...] = ("category", "sub_category")) -> DataFrame:
    """Match level of each block pair, with own, other (keep and profile), features, hard, matches and name_score."""
    p = block_pairs(profile(df, brands, keep, keys), own, keys)
    narrow = narrow_category(F.col("own.sub_category")) if "sub_category" in keys else F.lit(False)
    return judge(p, narrow).withColumn("name_score", token_jaccard(F.col("own.tokens"), F.col("other.tokens")))


#: All that the rules look at, but for the name score.
RULED = ["features", "family", "brand_conflict"]


def _ruling(keys: tuple[str, ...]):
    narrow = narrow_category(F.col("own.sub_category")) if "sub_category" in keys else F.lit(False)
    return lambda pairs: judge(pairs, narrow)


def assessed_levels(df: DataFrame, own: str, brands: list[str], keep: list[str], keys: tuple[str, ...] = ("category", "sub_category")) -> DataFrame:
    """own_<c>, other_<c> for c in keep, features (as a struct and by name), hard, matches and match_level of each block pair, judged
    by signature. By name a feature is not taken out of the struct once more for each pair."""
    p = profile(spread(df, keep[0]), brands, keep, keys)
    ruled = lambda pairs: _ruling(keys)(pairs).select("*", "features.*")
    return judged_pairs(p, own, keep, RULED, ruled, ["features", *FEATURES, "hard", "matches", "match_level"], keys)


def level_counts(df: DataFrame, own: str, brands: list[str], id_column: str = "product_id", keys: tuple[str, ...] = ("category", "sub_category")) -> DataFrame:
    """(match_level, pairs, own_products, other_products), counted by signatures without the pairs of a block."""
    held = signed(profile(spread(df, id_column), brands, [id_column], keys), [id_column], RULED, keys)
    judged = judged_signatures(held, own, RULED, _ruling(keys), ["match_level"], keys)
    judged = overwrite(judged, scratch(df.sparkSession, "signature-levels"))
    pairs, out = judged, None
    for name, side in zip(("own", "other"), sides(held, own), strict=True):
        one = side.select(F.col("sig").alias(f"{name}_sig"), F.col(f"kept_{id_column}").alias("id"))
        pairs = pairs.join(one.groupBy(f"{name}_sig").agg(F.count("*").alias(f"n_{name}")), f"{name}_sig")
        found = judged.select("match_level", f"{name}_sig").distinct().join(one, f"{name}_sig")
        found = found.groupBy("match_level").agg(F.count_distinct("id").alias(f"{name}_products"))
        out = found if out is None else out.join(found, "match_level")
    pairs = pairs.groupBy("match_level").agg(F.sum(F.col("n_own") * F.col("n_other")).alias("pairs"))
    return pairs.join(out, "match_level").select("match_level", "pairs", "own_products", "other_products")


LEVELS = {"STRONG_COMPARABLE": 4, "COMPARABLE": 3, "TYPE_ONLY": 2, "NO_DEFENSIBLE_MATCH": 1}


def best_candidates(assessed: DataFrame) -> DataFrame:
    """(own_id, best_id, best_level) of the valid candidates: level, technical matches, name score, smallest id.

    One partial maximum by product, no sort of its candidates."""
    level = T.first_rule([(F.col("match_level") == k, v) for k, v in LEVELS.items()], 0)
    order = F.struct(level.alias("level"), "matches", "name_score", (-F.col("other_id")).alias("id"), "match_level")
    best = assessed.where("match_level <> 'NO_DEFENSIBLE_MATCH'").groupBy("own_id").agg(F.max(order).alias("b"))
    return best.select("own_id", (-F.col("b.id")).alias("best_id"), F.col("b.match_level").alias("best_level"))


#: Price statuses that a comparison may use; of these, the promotional ones compare with each other only.
USABLE = ["VERIFIED_OFFICIAL_PRICE", "VERIFIED_OFFICIAL_SALE", "VERIFIED_RETAIL_PRICE", "VERIFIED_RETAIL_PROMOTIONAL_PRICE"]
PROMOTIONAL = ["VERIFIED_OFFICIAL_SALE", "VERIFIED_RETAIL_PROMOTIONAL_PRICE"]


def price_positioning(df: DataFrame) -> DataFrame:
    """Difference and premium of own against competitor prices where both sides are usable and alike (regular or promotion)."""
    usable = F.col("own_status").isin(*USABLE) & F.col("other_status").isin(*USABLE)
    own_promo, other_promo = F.col("own_status").isin(*PROMOTIONAL), F.col("other_status").isin(*PROMOTIONAL)
    priced = (F.col("own_price") > 0) & (F.col("other_price") > 0)
    state = T.first_rule([(~usable, "PRICE_COMPARISON_NOT_AVAILABLE"), (~F.coalesce(priced, F.lit(False)), "PRICE_COMPARISON_NOT_AVAILABLE"), (own_promo != other_promo, "PRICE_COMPARISON_REQUIRES_PROMOTION_ALIGNMENT")], "PRICE_COMPARISON_AVAILABLE")
    diff = F.col("own_price") - F.col("other_price")
    side = T.first_rule([(diff > 0, "PREMIUM"), (diff < 0, "DISCOUNT")], "PARITY")
    ok = state == "PRICE_COMPARISON_AVAILABLE"
    return df.select("*", state.alias("positioning_status"), F.when(ok, T.half_up(diff)).alias("difference"), F.when(ok, T.half_up(diff / F.col("other_price") * 100)).alias("premium_pct"), F.when(ok, side).alias("position"))


def evidence_verdict(regular: Column, sale: Column, every: Column, source: Column) -> Column:
    """Price status from the distinct regular, sale and all prices seen at a source; the type of an official source ends
    in _OFFICIAL. A sale price goes before a regular one, then a single price of any kind."""
    official = F.endswith(source, F.lit("_OFFICIAL"))
    pick = lambda a, b: F.when(official, a).otherwise(b)
    promotional = pick("VERIFIED_OFFICIAL_SALE", "VERIFIED_RETAIL_PROMOTIONAL_PRICE")
    plain = pick("VERIFIED_OFFICIAL_PRICE", "VERIFIED_RETAIL_PRICE")
    return T.first_rule([
        ((F.size(sale) == 1) & (F.size(regular) <= 1), promotional), ((F.size(regular) == 1) & (F.size(sale) == 0), plain),
        (F.size(every) == 1, plain), (F.size(every) > 1, "MULTIPLE_PRICE_CANDIDATES"),
        (official, "PRICE_NOT_EXPOSED_OFFICIAL_SOURCE"),
    ], "PRICE_NOT_FOUND")


def one_price(df: DataFrame, key: str) -> DataFrame:
    """The one price of each target, else that there are several or none."""
    prices = F.array_sort(F.collect_set("price"))
    state = T.first_rule([(F.size("prices") == 1, "ONE_PRICE"), (F.size("prices") > 1, "MULTIPLE_PRICES")], "NO_PRICE")
    out = df.groupBy(key).agg(prices.alias("prices"))
    return out.select(key, F.when(F.size("prices") == 1, F.col("prices")[0]).alias("price"), F.size("prices").cast("long").alias("n_prices"), state.alias("verdict"))


def two_sides(df: DataFrame, keep: list[str], sides: dict[str, list[str]], fields: list[str]) -> DataFrame:
    """A long table with one row for each comparison and side."""
    rows = F.array(*(F.struct(F.lit(s).alias("side"), *(F.col(c).alias(f) for c, f in zip(cols, fields, strict=True))) for s, cols in sides.items()))
    return df.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")

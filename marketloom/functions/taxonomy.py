"""Rule-table classification: weighted patterns, raw-category maps, models, brands and focus terms from titles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import text as T
from .dictionary import Machine, labels_in, machine_of


@dataclass(frozen=True)
class CategoryRule:
    """A pattern that speaks for a category and sub-category with a priority. level: specific; weak, which counts only where
    nothing specific does; category, which names no sub-category of its own.

    triggers: words of which the text must have one for the pattern to be tried; read off the pattern if not given, and
    none where that isn't plain, so that the rule is always tried."""

    category: str
    sub_category: str
    priority: int
    pattern: str
    level: str = "specific"
    triggers: tuple[str, ...] | None = None


def triggers_of(pattern: str) -> tuple[str, ...]:
    """The longest plain run of letters of each alternative; () if groups, classes or escapes make that unsure."""
    out = []
    for part in pattern.split("|"):
        runs = re.findall(r"[a-z]{2,}(?![?*{])|[a-z]{2,}(?=[a-z][?*{])", re.sub(r"\\b|\[ -\]\?|\[ \]\?| \?", "\n", part)) if re.fullmatch(r"(?:\\b|[a-z0-9 -]|\[ -\]|[?])*", part) else []
        runs = [r for r in runs if r + "?" not in part]
        if not runs:
            return ()
        out.append(max(runs, key=len))
    return tuple(dict.fromkeys(out))


#: Default appliance taxonomy; a parameter of classify(), given in order of precedence.
APPLIANCES = (
    CategoryRule("Refrigeration", "Side by Side", 90, r"side[ -]?by[ -]?side"),
    CategoryRule("Refrigeration", "Chest Freezer", 85, r"chest freezer"),
    CategoryRule("Refrigeration", "Double Door", 78, r"double[ -]?door|top[ -]?mount"),
    CategoryRule("Refrigeration", "Refrigeration - other", 10, r"fridge|refrigerator|freezer", "category"),
    CategoryRule("Laundry & Dishwashing", "Dishwashers", 90, r"dish ?washer"),
    CategoryRule("Laundry & Dishwashing", "Dryers", 80, r"\bdryers?\b|tumble"),
    CategoryRule("Laundry & Dishwashing", "Front Load", 78, r"front[ -]?load"),
    CategoryRule("Laundry & Dishwashing", "Top Load", 76, r"top[ -]?load"),
    CategoryRule("Laundry & Dishwashing", "Laundry - other", 10, r"washing machine|\bwasher\b", "category"),
    CategoryRule("Cooking", "Microwaves", 90, r"microwave"),
    CategoryRule("Cooking", "Gas Cookers", 84, r"gas cooker|standing cooker"),
    CategoryRule("Cooking", "Hobs", 80, r"\bhobs?\b|cooktop"),
    CategoryRule("Cooking", "Ovens", 70, r"\boven\b", "weak"),
    CategoryRule("TV & Audio", "TVs", 80, r"\btvs?\b|television|qled|oled"),
    CategoryRule("TV & Audio", "Sound", 78, r"sound ?bar|subwoofer|speaker"),
    CategoryRule("Air & Climate", "Air Conditioners", 90, r"air[ -]?condition|\bbtu\b"),
    CategoryRule("Air & Climate", "Fans", 70, r"\bfans?\b", "weak"),
    CategoryRule("Small Kitchen", "Kettles", 82, r"kettle"),
    CategoryRule("Small Kitchen", "Blenders", 74, r"blender"),
    CategoryRule("Water", "Water Dispensers", 90, r"water dispenser", "weak"),
)
HIT = "array<struct<category:string, sub:string, level:string, source:string, priority:int>>"


class RuleTable:
    """Category rules behind an automaton of their trigger words, with maps of raw values and of slugs."""

    def __init__(self, rules: tuple[CategoryRule, ...], raw_map: dict, slug_map: dict):
        self.rules = [(r, re.compile(r.pattern, re.I)) for r in rules]
        words: dict[str, list[int]] = {}
        self.always = []
        for i, r in enumerate(rules):
            own = triggers_of(r.pattern) if r.triggers is None else r.triggers
            for w in own:
                words.setdefault(w.lower(), []).append(i)
            if not own:
                self.always.append(i)
        self.own = list(words.values())
        self.machine = Machine([list(words)], whole=False)
        self.raw = {k.strip().lower(): v for k, v in raw_map.items()}
        self.slugs = {k.strip().lower(): v for k, v in slug_map.items()}

    def hits(self, text: str | None, raw: str | None) -> list[dict]:
        text, raw = text or "", raw or ""
        tried = sorted({i for w in self.machine.find(text.lower())[0] for i in self.own[w]} | set(self.always))
        hit = lambda c, s, level, source, p: {"category": c, "sub": s, "level": level, "source": source, "priority": p}
        out = [hit(r.category, r.sub_category, r.level, "name", r.priority) for r, rx in (self.rules[i] for i in tried) if rx.search(text)]
        if self.slugs:
            found = [(self.slugs[t], "slug") for t in (x.strip() for x in raw.lower().split(",")) if t in self.slugs]
        else:
            found = [(self.raw[raw.strip().lower()], "raw")] if raw.strip().lower() in self.raw else []
        return out + [hit(c, s, level, source, 50 if level == "specific" else 5) for (c, s, level), source in found]


_tables: dict = {}


def rule_hits(text: Column, raw: Column, rules: tuple[CategoryRule, ...], raw_map: dict, slug_map: dict) -> Column:
    """All hits of a text and its raw value, in rule order, from one Arrow function however many the rules are."""
    ship(SparkSession.active())

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        key = (rules, tuple(raw_map.items()), tuple(slug_map.items()))
        if key not in _tables:
            _tables.clear()
            _tables[key] = RuleTable(rules, raw_map, slug_map)
        kind = pa.list_(pa.struct([("category", pa.string()), ("sub", pa.string()), ("level", pa.string()), ("source", pa.string()), ("priority", pa.int32())]))
        for texts, raws in columns:
            yield pa.array([_tables[key].hits(t, r) for t, r in zip(texts.to_pylist(), raws.to_pylist())], kind)

    run.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, HIT)(text, raw)


#: The category of offers that name several, and what such offers say.
MULTI = "Multi-category"
MANY = r"(?i)up to \d+% off|clearance sale|selected appliances|everything you need|big discounts|extra \d+% off"
UMBRELLAS = ("multiple", "general appliances")


def resolve(hits: Column, text: Column, raw: Column, many: str = MANY, umbrellas: tuple[str, ...] = UMBRELLAS) -> Column:
    """struct(category, sub_category, confidence, status, method, reason) of hits.

    Specific hits count, weak ones if there are none, category hits if there are neither. One category maps to the hit of
    highest priority (the first of equals); two conflict; three or more are several categories. Without a hit, an offer
    that names no product is several categories too."""
    of = lambda level: F.filter(hits, lambda h: h["level"] == level)
    s = lambda c, sub, conf, status, method, reason: F.struct(*(
        (x if isinstance(x, Column) else F.lit(x)).alias(n) for x, n in ((c, "category"), (sub, "sub_category"), (conf, "confidence"), (status, "status"), (method, "method"), (reason, "reason"))
    ))
    names = lambda a, f: F.array_sort(F.array_distinct(F.transform(a, f)))

    def judged(x: Column) -> Column:
        strong = F.when(F.size(x["a"]) > 0, x["a"]).otherwise(x["b"])
        chosen = F.when(F.size(strong) > 0, strong).otherwise(x["c"])
        sure = (F.size(x["a"]) > 0) | (F.size(x["b"]) > 0)
        return F.transform(F.array(F.struct(chosen.alias("h"), sure.alias("sure"))), settled)[0]

    def settled(y: Column) -> Column:
        h, sure = y["h"], y["sure"]
        cats = names(h, lambda z: z["category"])
        order = F.transform(h, lambda z, i: F.struct(z["priority"].alias("p"), (-i).alias("i"), z["category"].alias("category"), z["sub"].alias("sub")))
        best = F.array_max(order)
        own = F.filter(h, lambda z: ~sure | (z["sub"] == best["sub"]))
        told = F.when(sure, F.array_join(names(h, lambda z: F.concat(z["category"], F.lit(" / "), z["sub"], F.lit(" ("), z["source"], F.lit(")"))), "; ")).otherwise(
            F.array_join(names(h, lambda z: F.concat(z["category"], F.lit(" ("), z["source"], F.lit(")"))), "; "))
        several = sure & (F.size(cats) >= 3)
        return (
            F.when(several, s(MULTI, "", "low", "review", "multi_category", F.concat(F.lit("names products in several categories: "), F.array_join(cats, ", "))))
            .when(F.size(cats) > 1, s("", "", "", "review", "conflict", F.concat(F.lit("conflict: "), told)))
            .otherwise(s(best["category"], best["sub"], F.when(sure, "high").otherwise("medium"), "mapped", F.array_join(names(own, lambda z: z["source"]), "+"), ""))
        )

    wide = F.coalesce(text.rlike(many), F.lit(False)) | F.lower(F.trim(F.coalesce(raw, F.lit("")))).isin(*umbrellas)
    parts = F.struct(of("specific").alias("a"), of("weak").alias("b"), of("category").alias("c"))
    return (
        F.when((F.size(hits) == 0) & wide, s(MULTI, "", "low", "review", "text_pattern", "offer spans many categories, no product named"))
        .when(F.size(hits) == 0, s("", "", "", "review", "none", "no rule matched"))
        .otherwise(F.transform(F.array(parts), judged)[0])
    )


def classify(text: Column, raw: Column, rules: tuple[CategoryRule, ...] = APPLIANCES, raw_map: dict | None = None, slug_map: dict | None = None, many: str = MANY, umbrellas: tuple[str, ...] = UMBRELLAS) -> Column:
    """struct(category, sub_category, confidence, status, method, reason) of a title and its raw category.

    raw_map, slug_map: value to (category, sub-category, level); with a slug map the raw category is a comma list of slugs."""
    hits = rule_hits(text, raw, rules, raw_map or {}, slug_map or {})
    return F.transform(F.array(hits), lambda h: resolve(h, text, raw, many, umbrellas))[0]


@dataclass(frozen=True)
class OrderedRule:
    """A rule of a precedence list over lower-cased text: one of any_of (if given), all of all_of, none of none_of, as substrings."""

    category: str
    sub_category: str
    any_of: tuple[str, ...] = ()
    all_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    confidence: str = "high"
    scope: str = "core_appliance"


def assign(text: Column, rules: tuple[OrderedRule, ...]) -> Column:
    """struct(category, sub_category, status, confidence, scope) of the first rule that holds; status review if none does.

    The terms of all rules are found in one pass; a rule is looked at only if one of the terms that it needs is there."""
    ship(SparkSession.active())
    kind = "struct<category:string, sub_category:string, status:string, confidence:string, scope:string>"

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms = list(dict.fromkeys(t for r in rules for t in (*r.any_of, *r.all_of, *r.none_of)))
        m, number = machine_of([terms], whole=False), {t: i for i, t in enumerate(terms)}
        need = [tuple({number[t] for t in x} for x in (r.any_of, r.all_of, r.none_of)) for r in rules]
        by_term: dict[int, list[int]] = {}
        for i, (one, every, _) in enumerate(need):
            for t in one or every:
                by_term.setdefault(t, []).append(i)
        free = [i for i, (one, every, _) in enumerate(need) if not one and not every]
        for batch in texts:
            out = []
            for text in batch.to_pylist():
                found = set(m.find(text)[0])
                tried = sorted({i for t in found for i in by_term.get(t, ())} | set(free))
                r = next((rules[i] for i in tried if (not need[i][0] or need[i][0] & found) and need[i][1] <= found and not need[i][2] & found), None)
                out.append((r.category, r.sub_category, "mapped", r.confidence, r.scope) if r else (None, None, "review", "low", None))
            yield pa.StructArray.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(5)], names=["category", "sub_category", "status", "confidence", "scope"])

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)(F.lower(F.coalesce(text, F.lit(""))))


def product_scope(category: Column, sub: Column, accessories: list[str]) -> Column:
    return T.first_rule([(category.isNull(), "other"), (F.lower(sub).isin(*accessories), "accessory")], "core")


def model_from_title(c: Column, fallback: Column | None = None) -> Column:
    """An explicit model label, else the first code of letters and digits, else the fallback."""
    label = F.regexp_extract(c, r"(?i)model(?: no)?[.:]? ?([A-Za-z0-9][A-Za-z0-9/_.-]{2,})", 1)
    code = F.regexp_extract(c, r"\b((?=[A-Z0-9/-]*[0-9])(?=[A-Z0-9/-]*[A-Z])[A-Z0-9][A-Z0-9/-]{3,})\b", 1)
    found = [F.when(label != "", F.upper(label)), F.when(code != "", code)]
    return F.coalesce(*found, *([fallback] if fallback is not None else []))


def brand_from_title(c: Column, brands: list[str]) -> Column:
    low = F.lower(c)
    return T.first_rule([(low.rlike(T.word(b.lower())), b) for b in brands]).cast("string")


def phrase_near(c: Column, terms: list[str], size: int = 60) -> Column:
    """Text from the earliest term on, up to a size; null if no term occurs."""
    low = F.lower(c)
    spots = F.array_compact(F.array(*(F.when(F.position(F.lit(t), low) > 0, F.struct(F.position(F.lit(t), low).alias("at"), F.lit(t).alias("term"))) for t in terms)))
    first = F.array_min(spots)
    return F.when(F.size(spots) > 0, F.trim(F.substring(c, first["at"], F.lit(size))))


def model_tokens(model: Column) -> Column:
    """The parts of a model number (split on / , ; |) and the whole, in upper case, each once."""
    whole = F.upper(T.squeeze(F.coalesce(model, F.lit(""))))
    parts = F.transform(F.split(whole, "[/,;|]+"), lambda p: F.trim(p))
    return F.array_distinct(F.filter(F.concat(parts, F.array(whole)), lambda p: p != ""))


def model_present(text: Column, model: Column) -> Column:
    """Whether the text has the model number or one of its parts."""
    return F.exists(model_tokens(model), lambda p: F.contains(F.upper(F.coalesce(text, F.lit(""))), p))


#: Words of a product name that tell nothing; own and rival brands are to be added by the caller.
PLAIN_WORDS = ["the", "and", "with", "for", "white", "black", "silver", "grey", "gray"]


def name_score(text: Column, name: Column, ignored: tuple[str, ...] = ()) -> Column:
    """Share of a name's words (three letters or digits and more, repeats counted) that stand anywhere in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("([a-z0-9]{3,})"), F.lit(1)), lambda w: ~w.isin(*PLAIN_WORDS, *ignored))
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(low, w))) / F.size(words)).otherwise(0.0)


def names_match(target: Column, name: Column) -> Column:
    """Equal names match; else two shared words of three letters or more, one if the target has three words at most."""
    clean = lambda c: F.lower(T.squeeze(F.coalesce(c, F.lit(""))))
    words = lambda c: F.array_distinct(F.regexp_extract_all(clean(c), F.lit("([a-z0-9]{3,})"), F.lit(1)))
    shared = F.size(F.array_intersect(words(target), words(name)))
    least = F.when(F.size(words(target)) <= 3, 1).otherwise(2)
    return (clean(target) != "") & (clean(name) != "") & ((clean(target) == clean(name)) | (shared >= least))


#: Product focus of a post, the first category with a term.
FOCUS = {
    "Refrigeration": ["fridge", "refrigerator", "freezer", "double door", "side by side", "chest freezer", "upright freezer"],
    "Laundry": ["washing machine", "washer", "dryer", "twin tub", "front load", "top load"],
    "Cooking": ["cooker", "oven", "gas cooker", "gas stove", "electric cooker", "microwave", "pressure cooker", "air fryer", "hot plate"],
    "Small Kitchen Appliances": ["blender", "kettle", "toaster", "sandwich maker", "coffee maker", "juicer", "food processor", "mixer"],
    "TV & Audio": ["television", "tv", "smart tv", "qled", "oled", "soundbar", "speaker", "home theatre"],
    "Air & Climate": ["air conditioner", "air conditioning", "ac unit", "fan", "air cooler"],
    "Water": ["water heater", "water dispenser", "water purifier"],
    "Home Care & Power": ["vacuum cleaner", "iron", "generator", "power backup", "inverter"],
    "Cookware": ["cookware", "frying pan", "saucepan", "pot set"],
}


def product_focus(text: Column, focus: dict[str, list[str]] = FOCUS) -> Column:
    """The first category with a term anywhere in the text; null if the text is too general."""
    return F.get(labels_in(T.squeeze(F.coalesce(text, F.lit(""))), focus, whole=False), F.lit(0))


#: What makes a search result one of a promotion or of a product.
PROMOTION_WORDS = ["promotion", "promo", "offer", "discount", "sale", "deal", "giveaway"]
PRODUCT_WORDS = ["launch", "new product", "new arrival", "introduced", "unveiled"]


def result_type(title: Column, snippet: Column) -> Column:
    """promotion, product or activity, from the words of a search result's title and snippet."""
    low = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(snippet, F.lit(""))))
    return T.first_rule([(T.contains_any(low, PROMOTION_WORDS), "promotion"), (T.contains_any(low, PRODUCT_WORDS), "product")], "activity")

"""Evidence retrieval, question routing and report datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def evidence_counts(tables: dict[str, DataFrame], scope: str = "competitor_id") -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.groupBy(scope).agg(F.count("*").alias("n")).select(scope, F.lit(name).alias("evidence_type"), "n")
        out = part if out is None else out.unionByName(part)
    return out


#: Rows of one alias that meet a copy of its list of competitors.
SCOPE_ROWS = 4096


def resolve_scope(df: DataFrame, competitors: DataFrame) -> DataFrame:
    """competitor_ids of each row's alias: every competitor with that name or brand, in any case."""
    names = competitors.select(F.lower("competitor_name").alias("key"), "competitor_id").union(competitors.select(F.lower("brand_name"), "competitor_id"))
    asked = df.distinct().withColumn("key", F.lower("alias"))
    lists = names.groupBy("key").agg(F.array_sort(F.collect_set("competitor_id")).alias("competitor_ids"))
    # a list is copied once for SCOPE_ROWS rows that ask for it, so rows of one alias are dealt to many tasks
    parts = asked.groupBy("key").agg(F.ceil(F.count("*") / SCOPE_ROWS).cast("int").alias("_parts"))
    copies = lists.join(parts, "key").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    rows = asked.join(parts, "key").withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.col("_parts")).cast("int")).drop("_parts")
    return rows.join(copies, ["key", "_part"]).select(*df.columns, "competitor_ids")


def mention_words(c: Column) -> Column:
    """Lower-cased words of [a-z0-9#&_]; each character beyond ASCII is a word of its own."""
    spaced = F.regexp_replace(F.lower(c), r"([^\x00-\x7f])", " $1 ")
    return F.split(F.trim(F.regexp_replace(spaced, r"[^a-z0-9#&_\x{80}-\x{10ffff}]+", " ")), " ")


def mentions(df: DataFrame, text: str, aliases: DataFrame) -> DataFrame:
    """(row, alias) for each alias that the text contains, in any case, between other characters than [a-z0-9#&_].

    Word runs of every length that occurs among the aliases are met by equality, so there is no nested loop; the pairs
    are then held against the text as it stands. A blank alias, or one of punctuation alone, meets nothing."""
    keyed = aliases.withColumn("_key", F.concat_ws(" ", mention_words("alias"))).where("_key <> ''")
    lengths = keyed.agg(F.array_sort(F.collect_set(F.size(F.split("_key", " "))))).scalar()
    words = mention_words(F.col(text))
    df = df.withColumn("_lengths", lengths).withColumn("_n", F.explode("_lengths")).where(F.size(words) >= F.col("_n"))
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - F.col("_n") + 1), lambda i: F.concat_ws(" ", F.slice(words, i, F.col("_n"))))
    grams = df.withColumn("_key", F.explode(F.array_distinct(runs))).drop("_lengths", "_n")
    name = F.concat(F.lit(r"\Q"), F.trim(F.lower("alias")), F.lit(r"\E"))  # in lower case it holds no \E itself
    found = F.regexp_like(F.lower(text), F.concat(F.lit("(^|[^a-z0-9#&_])"), name, F.lit("([^a-z0-9#&_]|$)")))
    return grams.join(keyed, "_key").where(found).drop("_key")


INTENTS = [
    ("CAMPAIGNS", ["campaign", "promotion", "offer", "sale"]),
    ("PRICE_MOVEMENTS", ["price movement", "price change", "price increase", "price decrease", "price drop", "prices change"]),
    ("STRATEGIC_ALERTS", ["alert", "warning"]),
    ("MARKET_TRENDS", ["market"]),
    ("SOCIAL_EVIDENCE", ["social", "facebook", "instagram", "post"]),
    ("PRODUCT_CATALOGUE", ["catalog", "products", "product range", "sku", "product launch"]),
    ("COMPETITOR_COMPARISON", ["compare", "comparison", "versus", " vs "]),
]


def question_intent(c: Column, alias: Column | None = None) -> Column:
    """The first intent with a term in the question; campaign questions split into active and upcoming.

    A question without such a term is about a competitor's activity if it names one (alias), else unsupported."""
    q = F.concat(F.lit(" "), T.squeeze(F.lower(c)), F.lit(" "))
    rules = []
    for name, terms in INTENTS:
        hit = T.contains_any(q, terms)
        if name == "CAMPAIGNS":
            rules += [(hit & T.contains_any(q, ["active", "currently running"]), "CAMPAIGNS_ACTIVE"), (hit & T.contains_any(q, ["upcoming", "next", "coming"]), "CAMPAIGNS_UPCOMING")]
        rules.append((hit, name))
    if alias is not None:
        rules.append((alias.isNotNull(), "COMPETITOR_ACTIVITY"))
    return T.first_rule([(F.trim(q) == "", "UNSUPPORTED"), *rules], "UNSUPPORTED")


def longest_alias(c: Column, aliases: dict[str, str]) -> Column:
    """Canonical name of the longest alias that stands as a word; of equal lengths the last name."""
    q = T.squeeze(F.lower(c))
    hits = F.array_compact(F.array(*(F.when(q.rlike(T.word(a)), F.struct(F.lit(len(a)).alias("n"), F.lit(k).alias("name"))) for a, k in aliases.items())))
    return F.array_max(hits)["name"]


#: Wordings that ask for research outside, and intents without an internal answer.
ASKS_FOR_WEB = [
    "search the web", "search online", "search the internet", "look online", "look it up online", "check online", "check the web", "check the internet", "web research",
    "external research", "online research", "what is online", "according to the web", "according to online sources",
]
NO_INTENT = ["", "UNKNOWN", "UNSUPPORTED", "GENERAL", "INTERNAL_ERROR"]


def needs_research(question: Column, intent: Column, answer: Column, evidence: Column, confidence: Column) -> Column:
    """Research outside is needed if the question asks for it, if no intent or answer was found, or if an answer without
    evidence rows is not of high confidence. Words such as latest or market alone never call for it."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return (
        F.when(T.contains_any(F.lower(blank(question)), ASKS_FOR_WEB), True)
        .when(F.upper(blank(intent)).isin(*NO_INTENT), True)
        .when(blank(answer) == "", True)
        .when(F.coalesce(evidence, F.lit(0)) > 0, False)
        .otherwise(F.upper(blank(confidence)).isin("LOW", "MEDIUM"))
    )


def record_summary(df: DataFrame, fields: list[str], mode: str | None = None) -> DataFrame:
    """(field, value, n) for every value of some fields, counted in one pass, and the most frequent value of one as field mode
    (the first of equals)."""
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("UNKNOWN")).alias("value")) for f in fields))
    counts = df.select(F.explode(rows).alias("r")).select("r.*").groupBy("field", "value").agg(F.count("*").alias("n"))
    if mode is None:
        return counts
    top = counts.where(F.col("field") == mode).orderBy(F.desc("n"), "value").limit(1)
    return counts.unionByName(top.select(F.lit("mode").alias("field"), "value", "n"))

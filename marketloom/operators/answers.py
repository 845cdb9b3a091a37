"""Answers to routed questions: evidence tables as lines of one schema, composed once for each distinct intent and scope.

A line belongs to one subject (a competitor id, a brand or a catalogue, as text in lower case; null: to nobody) and has a
place in its list. A question's scope is an array of subjects; null takes every line, an empty one none. Counts and first
lines are reduced by subject before they meet scopes, so what is joined never grows with the lines of a subject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: By intent, how the answer begins, what it says without lines, and how many lines it shows.
#: {n} is the number of lines, {s} a plural s, {for} the scope as " for name".
TEXTS = {
    "CAMPAIGNS": ("The current evidence set contains {n} campaign{s}:", "No campaigns were retrieved{for} in the current evidence set.", 20),
    "CAMPAIGNS_ACTIVE": ("The current evidence set contains {n} campaign{s}:", "No campaigns were retrieved{for} in the current evidence set.", 20),
    "CAMPAIGNS_UPCOMING": ("The current evidence set contains {n} upcoming campaign{s}:", "No upcoming campaigns were retrieved{for} in the current evidence set.", 20),
    "STRATEGIC_ALERTS": ("{n} open strategic alert{s} were retrieved:", "No open strategic alerts were retrieved{for}.", 20),
    "MARKET_TRENDS": ("{n} market-trend record{s} were retrieved:", "No matching market-trend records were retrieved{for}.", 20),
    "SOCIAL_EVIDENCE": ("{n} social observation{s} were retrieved:", "No matching social evidence was retrieved{for}.", 10),
    "PRODUCT_CATALOGUE": ("Tracked catalogue coverage:", "No matching tracked catalogue summary was retrieved{for}.", 20),
    "COMPETITOR_COMPARISON": ("{n} comparison records were retrieved:", "No matching competitor comparison records were retrieved{for}.", 20),
    "COMPETITOR_ACTIVITY": ("Current documented activity{for}:", "No current evidence was retrieved{for}.", 5),
}
#: What an answer about a competitor's activity counts, in this order, and the label of a sample.
ACTIVITY = [
    ("CAMPAIGNS_ACTIVE", "Active campaigns", "Campaign"), ("CAMPAIGNS_UPCOMING", "Upcoming campaigns", "Upcoming campaign"), ("STRATEGIC_ALERTS", "Open strategic alerts", "Alert"),
    ("SOCIAL_EVIDENCE", "Social observations", "Social"), ("MARKET_TRENDS", "Market-trend records involving this scope", "Trend"),
]
#: Intents that answer nothing unless a scope is named.
NEEDS_SCOPE = ("COMPETITOR_COMPARISON",)
MOST = max(k for _, _, k in TEXTS.values())


def _or(c, otherwise: str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(otherwise))


def _say(*parts) -> Column:
    """Parts joined; a null part of a pair (label, column) leaves its label out too."""
    return F.concat(*(F.coalesce(F.concat(F.lit(p[0]), p[1].cast("string")), F.lit("")) if isinstance(p, tuple) else F.lit(p) if isinstance(p, str) else p for p in parts))


def _filled(c: str) -> Column:
    return F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string"))


def _lines(df: DataFrame, intent: str, subject: Column, place: Column, line: Column, evidence: Column, brief: Column) -> DataFrame:
    return df.select(
        F.lit(intent).alias("intent"), F.lower(subject.cast("string")).alias("subject"), place.cast("string").alias("place"),
        line.alias("line"), evidence.alias("evidence"), brief.alias("brief"),
    )


def campaign_lines(df: DataFrame, place: Column, intent: str = "CAMPAIGNS") -> DataFrame:
    name, period = _or("campaign_name", "not recorded"), T.period_label(F.col("start_date"), F.col("end_date"))
    line = _say(name, " (", period, ")", (" - ", _filled("offer_value")), (" - category: ", _filled("category")))
    evidence = _say(name, ": verification=", _or("verification_status", "not recorded"), ", confidence=", _or("confidence", "not recorded"), ", source=", F.coalesce(_filled("source_url"), F.lit("not recorded")))
    return _lines(df, intent, F.col("competitor_id"), place, line, evidence, _say(name, " - ", period))


def alert_lines(df: DataFrame, place: Column) -> DataFrame:
    title, kind = _or("title", "not recorded"), F.col("alert_type")
    line = _say("[", _or("priority", "not recorded"), "] ", title, " - ", kind)
    evidence = _say(title, ": source=", _or("evidence_source", "not recorded"), ", period=", T.period_label(F.col("period_start"), F.col("period_end")), ", confidence=", _or("confidence", "not recorded"))
    return _lines(df, "STRATEGIC_ALERTS", F.col("subject"), place, line, evidence, _say(title, " - priority=", _or("priority", "not recorded")))


def trend_lines(df: DataFrame, place: Column) -> DataFrame:
    title, status = _or("title", "not recorded"), _or("status", "not recorded")
    line = _say(title, " - ", F.col("signal_type"), " - ", status, " - ", T.period_label(F.col("start_date"), F.col("end_date")))
    evidence = _say(title, ": evidence_count=", _or("evidence_count", "0"), ", confidence=", _or("confidence", "not recorded"))
    return _lines(df, "MARKET_TRENDS", F.col("subject"), place, line, evidence, _say(title, " - status=", status))


def social_lines(df: DataFrame, place: Column, most: int = 180) -> DataFrame:
    said = F.trim(F.coalesce("post_text", F.lit("")))
    said = F.when(said == "", "post text not captured").when(F.length(said) > most, F.concat(F.substring(said, 1, most - 3), F.lit("..."))).otherwise(said)
    platform, seen = _or("platform", "not recorded"), _or("observed_date", "not recorded")
    evidence = _say(
        platform, " / ", _or("account_name", "not recorded"), ": published=", _or("published_date", "not recorded"), ", observed=", seen,
        ", verification=", _or("verification_status", "not recorded"), ", confidence=", _or("confidence", "not recorded"),
    )
    return _lines(df, "SOCIAL_EVIDENCE", F.col("competitor_id"), place, _say(platform, " - ", seen, " - ", said), evidence, _say(platform, " - observed=", seen))


def catalogue_lines(df: DataFrame, place: Column) -> DataFrame:
    name, first, last, n = F.col("catalogue"), _or("first_seen", "not recorded"), _or("last_seen", "not recorded"), _or("product_count", "0")
    evidence = _say(name, ": ", n, " products, first_seen=", first, ", last_seen=", last)
    return _lines(df, "PRODUCT_CATALOGUE", F.trim(name), place, _say(name, ": ", n, " tracked products (", first, " to ", last, ")"), evidence, evidence)


def comparison_lines(df: DataFrame, place: Column) -> DataFrame:
    who = _say(F.coalesce(_filled("competitor_name"), F.lit("Unknown competitor")), (" / ", _filled("brand")))
    dimension, metric = F.coalesce(_filled("dimension"), F.lit("Unknown dimension")), F.coalesce(_filled("metric_name"), F.lit("Unknown metric"))
    n, coverage, period = _or("observation_count", "0"), F.coalesce(_filled("coverage_status"), F.lit("not recorded")), T.period_label(F.col("period_start"), F.col("period_end"))
    line = _say(who, " - ", dimension, " - ", metric, " - observations=", n, (" | value=", F.col("metric_value")), " - period=", period, " - coverage=", coverage)
    evidence = _say(
        who, ": ", dimension, " / ", metric, "; observations=", n, "; period=", period, "; coverage=", coverage,
        "; confidence=", F.coalesce(_filled("confidence"), F.lit("not recorded")), "; evidence=", _or("evidence_summary", "not recorded"),
    )
    return _lines(df, "COMPETITOR_COMPARISON", F.col("competitor_id"), place, line, evidence, line)


def _first(rows: DataFrame, keys: list[str], most: Column | int) -> DataFrame:
    """The first lines of each key; ties of place go by line and evidence."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("place", "line", "evidence"))
    return rows.withColumn("_at", at).where(F.col("_at") <= MOST).where(F.col("_at") <= most)


def compose(routed: DataFrame, lines: DataFrame) -> DataFrame:
    """routed with n_rows, answer and evidence (array, in the order of the lines shown).

    routed has intent, named (the scope's name as asked, or null) and scope (array of subjects, or null). Beyond the lines that an
    intent shows, the answer counts the rest. An unknown intent gets a null answer, no rows and no evidence."""
    asked = routed.select("intent", "named", F.array_distinct(F.transform("scope", lambda s: F.lower(s.cast("string")))).alias("scope")).distinct()
    asked = asked.withColumn("_key", F.sha2(F.to_json(F.struct("intent", "named", F.array_sort("scope").alias("scope"))), 256)).dropDuplicates(["_key"])
    fan = F.when(F.col("intent") == "COMPETITOR_ACTIVITY", F.array(*(F.lit(p) for p, _, _ in ACTIVITY))).otherwise(F.array("intent"))
    everyone = F.when(F.col("intent").isin(*NEEDS_SCOPE), F.array().cast("array<string>")).otherwise(F.array(F.lit("*")))
    mine = F.transform("scope", lambda s: F.concat(F.lit("="), s))  # no subject is taken for everyone
    spread = asked.select("_key", F.col("intent").alias("_asked"), F.explode(fan).alias("intent"), F.coalesce(mine, everyone).alias("_of"))
    spread = spread.withColumn("_of", F.explode("_of"))

    both = F.explode(F.array_compact(F.array(F.concat(F.lit("="), "subject"), F.lit("*"))))
    totals = lines.groupBy("intent", "subject").agg(F.count("*").alias("n")).withColumn("_of", both).groupBy("intent", "_of").agg(F.sum("n").alias("n"))
    own = _first(lines, ["intent", "subject"], MOST).drop("_at").withColumn("_of", both)
    top = _first(own, ["intent", "_of"], MOST).drop("_at")

    counted = spread.join(totals, ["intent", "_of"]).groupBy("_key", "intent").agg(F.sum("n").alias("n"))
    most = T.first_rule([(F.col("_asked") == k, F.lit(n)) for k, (_, _, n) in TEXTS.items()], F.lit(MOST))
    shown = _first(spread.join(top, ["intent", "_of"]), ["_key", "intent"], most)
    briefly = F.col("_asked") == "COMPETITOR_ACTIVITY"
    label = T.first_rule([(F.col("intent") == p, F.lit(one)) for p, _, one in ACTIVITY], F.lit(""))
    proof = F.when(briefly, F.concat(label, F.lit(": "), "brief")).otherwise(F.col("evidence"))
    held = F.array_sort(F.collect_list(F.struct("_at", "line", proof.alias("proof"))))
    shown = shown.groupBy("_key", "intent").agg(held.alias("shown"))
    order = F.array_position(F.array(*(F.lit(p) for p, _, _ in ACTIVITY)), F.col("intent"))
    part = counted.join(shown, ["_key", "intent"], "left").select("_key", F.struct(order.alias("at"), "intent", "n", "shown").alias("p"))
    found = part.groupBy("_key").agg(F.array_sort(F.collect_list("p")).alias("parts"))

    kinds = {p: many for p, many, _ in ACTIVITY}
    activity = F.transform("parts", lambda p: F.concat(T.first_rule([(p["intent"] == k, F.lit(v)) for k, v in kinds.items()], ""), F.lit(": "), p["n"].cast("string")))
    listed = F.transform(F.flatten(F.transform("parts", lambda p: p["shown"])), lambda s: s["line"])
    total = F.coalesce(F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"]), F.lit(0).cast("long"))
    n = F.col("n_rows")
    about = F.col("intent") == "COMPETITOR_ACTIVITY"
    more = n - F.size("_listed")
    rest = F.when(~about & (more > 0), F.concat(F.lit("\n- ...and "), more.cast("string"), F.lit(" additional."))).otherwise("")

    def told(template: str) -> Column:
        c = F.lit(template)
        for token, value in (("{n}", n.cast("string")), ("{s}", F.when(n == 1, "").otherwise("s")), ("{for}", F.coalesce(F.concat(F.lit(" for "), "named"), F.lit("")))):
            if token in template:
                c = F.replace(c, F.lit(token), value)
        return c

    begin = T.first_rule([(F.col("intent") == k, told(a)) for k, (a, _, _) in TEXTS.items()])
    nothing = T.first_rule([(F.col("intent") == k, told(b)) for k, (_, b, _) in TEXTS.items()])
    text = F.concat(begin, F.lit("\n- "), F.concat_ws("\n- ", "_listed"), rest)
    evidence = F.transform(F.flatten(F.transform("parts", lambda p: p["shown"])), lambda s: s["proof"])
    done = asked.join(found, "_key", "left").select("intent", "named", "_key", "parts", total.alias("n_rows"), F.when(about, activity).otherwise(listed).alias("_listed"))
    done = done.select(
        "intent", "named", "_key", "n_rows", F.when(n == 0, nothing).otherwise(text).alias("answer"),
        F.coalesce(evidence, F.array().cast("array<string>")).alias("evidence"),
    )
    scope = F.array_sort(F.array_distinct(F.transform("scope", lambda s: F.lower(s.cast("string")))))
    keyed = routed.withColumn("_key", F.sha2(F.to_json(F.struct("intent", "named", scope.alias("scope"))), 256))
    return keyed.join(done.drop("intent", "named"), "_key").drop("_key")

"""Catalogue history, coverage, position and gap operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def coverage_matrix(df: DataFrame, keys: list[str], brands: dict[str, str]) -> DataFrame:
    """Counts by key and brand with a total; a brand that is missing from a key counts 0."""
    named = df.where(F.col("brand").isin(*brands)).select(*keys, F.create_map(*(F.lit(x) for kv in brands.items() for x in kv))[F.col("brand")].alias("b"))
    wide = named.groupBy(*keys).pivot("b", list(brands.values())).count().na.fill(0)
    every = df.select(*keys).distinct().join(wide, keys, "left").na.fill(0)
    return every.withColumn("total", sum((F.col(b) for b in brands.values()), F.lit(0)).cast("long"))


def identifier_coverage(df: DataFrame) -> DataFrame:
    has = F.col("model_no") != ""
    pct = T.half_up(F.count_if(has) / F.count("*") * 100, 1)
    return df.groupBy("brand").agg(F.count_if(has).alias("available"), F.count_if(~has).alias("missing"), F.count_distinct(F.when(has, F.col("model_no"))).alias("unique_models"), pct.alias("pct"))


def validation_summary(df: DataFrame) -> DataFrame:
    n = lambda c, v, a: F.count_if(F.col(c) == v).alias(a)
    return df.groupBy("brand").agg(F.count("*").alias("products"), n("mapping_status", "MAPPED", "mapped"), n("mapping_status", "REVIEW", "review"), n("mapping_confidence", "HIGH", "high"),
        n("mapping_confidence", "MEDIUM", "medium"), n("mapping_confidence", "LOW", "low"), n("product_scope", "core", "core"))


def own_rival(df: DataFrame, own: str, keys: tuple[str, ...] = ("category", "sub_category")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(F.col("brand") == own).alias("own"), F.count_if(F.col("brand") != own).alias("rival"))


def position(own: Column, rival: Column) -> Column:
    return T.first_rule([((own > 0) & (rival > 0), "SHARED"), (own > 0, "OWN_ONLY"), (rival > 0, "COMPETITOR_ONLY")], "NO_COVERAGE")


def gap_signals(df: DataFrame) -> DataFrame:
    """Coverage, breadth and assessment of own and rival counts."""
    own, rival = F.col("own"), F.col("rival")
    coverage = position(own, rival)
    shared = coverage == "SHARED"
    breadth = T.first_rule([
        (shared & (own > rival), "OWN_CATALOGUE_BREADTH_HIGHER"), (shared & (own < rival), "COMPETITOR_CATALOGUE_BREADTH_HIGHER"), (shared, "SIMILAR_CATALOGUE_BREADTH"),
        (coverage == "OWN_ONLY", "OWN_UNIQUE_COVERAGE"), (coverage == "COMPETITOR_ONLY", "COMPETITOR_COVERAGE_NOT_IN_OWN_CATALOGUE"),
    ], "NO_COVERAGE")
    assess = F.when(coverage.isin("OWN_ONLY", "COMPETITOR_ONLY"), "VALIDATE_BEFORE_GAP_CLAIM").otherwise("COMPARABLE_COVERAGE")
    return df.select("category", "sub_category", "own", "rival", coverage.alias("coverage"), breadth.alias("breadth"), assess.alias("assessment"))


def gap_rollup(df: DataFrame) -> DataFrame:
    own, rival = F.col("own"), F.col("rival")
    return df.groupBy("category").agg(F.count("*").alias("sub_categories"), F.sum("own").alias("own"), F.sum("rival").alias("rival"),
        F.count_if((own > 0) & (rival > 0)).alias("shared"), F.count_if((own == 0) & (rival > 0)).alias("gaps"))


def model_quality(c: Column, brands: tuple[str, ...] = ()) -> Column:
    """missing: blank; weak: a placeholder or brand name, under four characters, or a bare number or measure; else reliable."""
    m = F.upper(T.squeeze(c))
    measure = m.rlike(r"^[0-9]+([.][0-9]+)?\s*(W|KW|L|KG|CM|MM|INCH|INCHES)?$")
    weak = m.isin("N/A", "NA", "NONE", "UNKNOWN", *(b.upper() for b in brands)) | (F.length(m) < 4) | measure
    return T.first_rule([(m == "", "missing"), (weak, "weak")], "reliable")


def identity_string(identifier: Column, *parts: Column) -> Column:
    """The identifier, else the joined parts."""
    ident = T.squeeze(identifier)
    return F.when(ident != "", ident).otherwise(F.concat_ws(" | ", *map(T.squeeze, parts)))


def new_product_status(first_seen: Column, baseline: str) -> Column:
    day = F.lit(baseline).cast("date")
    return T.first_rule([(first_seen.isNull(), "INSUFFICIENT_HISTORY"), (first_seen > day, "NEW_PRODUCT_CANDIDATE")], "BASELINE_PRODUCT")


def new_model_status(first_seen: Column, quality: Column, baseline: str) -> Column:
    day = F.lit(baseline).cast("date")
    return T.first_rule([(first_seen.isNull(), "INSUFFICIENT_HISTORY"), (first_seen <= day, "BASELINE_MODEL"), (quality == "reliable", "NEW_MODEL_CANDIDATE"), (quality == "weak", "MODEL_IDENTIFIER_WEAK")], "MODEL_IDENTIFIER_MISSING")


def date_range(df: DataFrame) -> DataFrame:
    first, last = F.col("first_seen_date"), F.col("last_seen_date")
    return df.agg(F.least(F.min(first), F.min(last)).alias("first_date"), F.greatest(F.max(first), F.max(last)).alias("last_date"))


def historical_presence(df: DataFrame, keys: list[str], days: int = 7) -> DataFrame:
    """Short or undated histories are insufficient, a gap up to the catalogue's last date may be a discontinuation, others are current."""
    last = df.agg(F.max("last_seen_date").alias("catalogue_last"))
    j = df.crossJoin(F.broadcast(last))  # one row
    span = F.datediff("last_seen_date", "first_seen_date")
    gap = F.datediff("catalogue_last", "last_seen_date")
    state = T.first_rule([(span.isNull() | (span < days), "INSUFFICIENT_HISTORY"), (gap >= days, "POSSIBLE_DISCONTINUATION")], "CURRENTLY_OBSERVED")
    return j.select(*keys, span.alias("span_days"), gap.alias("gap_days"), state.alias("presence"))


def suspicious_reasons(df: DataFrame) -> Column:
    """Reasons to review a mapping, in a fixed order."""
    return F.array_compact(F.array(
        F.when(F.col("mapping_confidence") == "LOW", "low confidence"), F.when(F.col("mapping_status") == "REVIEW", "unmapped"),
        F.when(F.col("model_no") == "", "no model"), F.when(F.col("product_scope") != "core", "not a core product"),
    ))


#: Words of a launch in an official, dated source, and those of a possible one anywhere.
CONFIRMED_TERMS = ["LAUNCH", "LAUNCHED", "LAUNCHING", "INTRODUCING"]
CANDIDATE_TERMS = ["NEW ARRIVAL", "INTRODUCING", "NEW PRODUCT", "JUST LAUNCHED", "NOW AVAILABLE"]


def launch_evidence(text: Column, dated_official: Column) -> Column:
    """CONFIRMED_LAUNCH, LAUNCH_CANDIDATE or FIRST_OBSERVED from an evidence text; only a dated official source confirms."""
    said = F.upper(F.coalesce(text, F.lit("")))
    sure = F.coalesce(dated_official, F.lit(False)) & T.contains_any(said, CONFIRMED_TERMS)
    return T.first_rule([(sure, "CONFIRMED_LAUNCH"), (T.contains_any(said, CANDIDATE_TERMS), "LAUNCH_CANDIDATE")], "FIRST_OBSERVED")

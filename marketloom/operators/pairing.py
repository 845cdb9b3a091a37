"""Best and defensible matches without the pairs of a block.

Products of a block that have the same features and family are alike to every rule but the name score. So pairs are judged
between signatures (block, family, features), found by an inverted index on feature values: a pair enters at its first
equal feature, so it enters once. Defensible pairs need an equal feature, so they are the products of those signatures.

The best match of a product comes from the signatures of its highest level and number of matches; a product without an
equal feature anywhere falls back to products of its family, grouped by which deciding features they state (a stated
feature on both sides would be equal or a conflict). Among the candidates, the name decides: a set-similarity search by
prefixes of rare tokens, at falling thresholds, each for the products that the one before left open; then the smallest id.
The last threshold meets every candidate that shares a token, for products that no name resembles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import overwrite, scratch
from .blocks import meet, numbered, spread
from .matching import FEATURES, HARD, LEVELS, judge, narrow_category, profile

#: Thresholds of name similarity in per cent, falling; 0 stands for any shared token.
THRESHOLDS = (70, 40, 20, 0)
#: Features in the order in which equal values are looked for: telling ones first.
LOOKUP = ["litres", "btu", "tv_inches", "width_cm", "burners", "installation", "inverter"]


def _written(df: DataFrame, label: str) -> DataFrame:
    return overwrite(df, scratch(df.sparkSession, label))


def _signed(df: DataFrame, brands: list[str], keep: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Profiles with their signature, written and numbered; products that name another brand match nothing and are left out.

    They go after the writing: before, the patterns would run ahead of spread, in the few tasks that read df."""
    p = profile(spread(df, keep[0]), brands, keep, keys)
    p = numbered(p.withColumn("sig", F.md5(F.to_json(F.struct(*keys, "family", "features")).cast("binary"))), "profiles")
    return p.where("not brand_conflict")


def _judged(p: DataFrame, own: str, keys: tuple[str, ...]) -> DataFrame:
    """(own_sig, other_sig, level, matches, match_level) of the signature pairs with an equal feature and a valid level."""
    sigs = p.select("sig", *keys, "features", "family", (F.col("brand") == own).alias("mine")).distinct()
    values = F.filter(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"features.{f}").cast("string").alias("v")) for i, f in enumerate(LOOKUP))), lambda x: x["v"].isNotNull())
    row = F.struct("sig", "features", "family", F.lit(False).alias("brand_conflict"))
    posted = sigs.select(*keys, "mine", row.alias("row"), F.explode(values).alias("at")).select(*keys, "mine", "row", "at.f", "at.v")
    mine, others = posted.where("mine").drop("mine").withColumnRenamed("row", "own"), posted.where("not mine").drop("mine").withColumnRenamed("row", "other")
    pairs = mine.join(others, [*keys, "f", "v"])
    first = T.first_rule([(F.col(f"own.features.{f}") == F.col(f"other.features.{f}"), F.lit(i)) for i, f in enumerate(LOOKUP)])
    narrow = narrow_category(F.col("sub_category")) if "sub_category" in keys else F.lit(False)
    judged = judge(pairs.where(F.col("f") == first), narrow).where("match_level <> 'NO_DEFENSIBLE_MATCH'")
    level = T.first_rule([(F.col("match_level") == k, F.lit(v)) for k, v in LEVELS.items()])
    return judged.select(F.col("own.sig").alias("own_sig"), F.col("other.sig").alias("other_sig"), level.alias("level"), "matches", "match_level")


def defensible_pairs(df: DataFrame, own: str, brands: list[str], keep: list[str], id_column: str = "product_id", keys: tuple[str, ...] = ("category", "sub_category")) -> DataFrame:
    """(own_id, other_id, match_level, own_<c>, other_<c> for c in keep) of the STRONG_COMPARABLE and COMPARABLE pairs."""
    p = _signed(df, brands, [id_column, *keep], keys)
    pairs = _judged(p, own, keys).where("match_level in ('STRONG_COMPARABLE', 'COMPARABLE')").select("own_sig", "other_sig", "match_level")
    side = lambda name, mine: p.where(mine).select(F.col("sig").alias(f"{name}_sig"), "_no", F.col(id_column).alias(f"{name}_id"), *(F.col(c).alias(f"{name}_{c}") for c in keep))
    out = meet(side("own", F.col("brand") == own), side("other", F.col("brand") != own), pairs, ["own_sig"], ["other_sig"])
    return out.select("own_id", "other_id", "match_level", *(f"{s}_{c}" for c in keep for s in ("own", "other")))


def _classes(p: DataFrame, own: str, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(own_sig, grp, match_level) of the best class of each own signature, and (grp, id, tokens) of the products in groups."""
    judged = _written(_judged(p, own, keys), "signature-pairs")
    order = F.struct("level", "matches")
    best = judged.withColumn("_best", F.max(order).over(W.partitionBy("own_sig"))).where(F.col("_best") == order)
    found = best.select("own_sig", F.col("other_sig").alias("grp"), "match_level")
    stated = sum((F.when(F.col(f"features.{f}").isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(HARD)), F.lit(0)).alias("stated")
    known = p.where("family is not null")
    fallback = F.md5(F.to_json(F.struct(F.lit("family").alias("_by"), *keys, "family", "stated")).cast("binary"))
    left = known.where(F.col("brand") == own).select(F.col("sig").alias("own_sig"), *keys, "family", stated).distinct()
    left = left.join(judged.select("own_sig").distinct(), "own_sig", "left_anti").withColumnRenamed("stated", "own_stated")
    groups = known.where(F.col("brand") != own).select(*keys, "family", stated).distinct()
    rest = left.join(groups, [*keys, "family"]).where(F.col("own_stated").bitwiseAND(F.col("stated")) == 0)
    classes = _written(found.unionByName(rest.select("own_sig", fallback.alias("grp"), F.lit("TYPE_ONLY").alias("match_level"))), "classes")
    others = p.where(F.col("brand") != own).select("*", stated)
    grouped = others.select("id", "tokens", F.explode(F.array(F.col("sig"), F.when(F.col("family").isNotNull(), fallback))).alias("grp"))
    return classes, grouped.where("grp is not null").join(classes.select("grp").distinct(), "grp", "left_semi")


def _by_rarity(rows: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, tokens) with their tokens in the order of (count, token)."""
    one = rows.select(*keys, F.explode("tokens").alias("token")).join(counts, "token", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")))
    return one.groupBy(*keys).agg(F.transform(order, lambda x: x["token"]).alias("tokens"))


def _prefix(tokens: Column, per_cent: int) -> Column:
    """So many of the rarest tokens that sets of this similarity must share one."""
    return F.slice(tokens, 1, F.size(tokens) - F.ceil(F.size(tokens) * per_cent / 100).cast("int") + (1 if per_cent else 0))


def most_alike(asked: DataFrame, held: DataFrame, allowed: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """(q, id) for asked(q, own_sig, tokens) and held(grp, id, tokens): the id of highest token similarity, then smallest, of
    the groups that allowed(own_sig, grp) gives; rows without a candidate are left out."""
    distinct = held.groupBy("grp", F.array_sort("tokens").alias("tokens")).agg(F.min("id").alias("id"))
    distinct = _written(distinct, "held")
    counts = distinct.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    lists = _written(_by_rarity(distinct, counts, ["grp", "id"]).withColumnRenamed("tokens", "y"), "held-tokens")
    open_ = _written(_by_rarity(asked, counts, ["q", "own_sig"]).withColumnRenamed("tokens", "x"), "asked-tokens")
    done = []
    for t in thresholds:
        left = open_.join(allowed, "own_sig").select("q", "grp", "x", F.explode(_prefix(F.col("x"), t)).alias("token"))
        right = lists.select("grp", "id", "y", F.explode(_prefix(F.col("y"), t)).alias("token"))
        a, b = F.size("x"), F.size("y")
        fit = left.join(right, ["grp", "token"]).where((a * 100 >= b * t) & (b * 100 >= a * t))
        both = F.size(F.array_intersect("x", "y"))
        scored = fit.select("q", "id", both.alias("n"), (a + b - both).alias("m")).where((F.col("n") * 100 >= F.col("m") * t) & (F.col("n") > 0))
        best = scored.groupBy("q").agg(F.max(F.struct((F.col("n") / F.col("m")).alias("score"), (-F.col("id")).alias("id"))).alias("b"))
        done.append(_written(best.select("q", (-F.col("b.id")).alias("id")), f"alike-{t}"))
        open_ = open_.join(done[-1], "q", "left_anti")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    least = allowed.join(distinct.groupBy("grp").agg(F.min("id").alias("id")), "grp").groupBy("own_sig").agg(F.min("id").alias("id"))
    rest = asked.select("q", "own_sig").join(found, "q", "left_anti").join(least, "own_sig").select("q", "id")
    return found.unionByName(rest)


def best_matches(df: DataFrame, own: str, brands: list[str], id_column: str = "product_id", keys: tuple[str, ...] = ("category", "sub_category")) -> DataFrame:
    """(own_id, best_id, best_level) of the valid matches: level, technical matches, name score, smallest id.

    Rows of df are products with a unique id; products without a valid match are left out."""
    p = _signed(df, brands, [id_column], keys).withColumnRenamed(id_column, "id")
    classes, held = _classes(p, own, keys)
    mine = p.where(F.col("brand") == own).select("id", F.col("sig").alias("own_sig"), F.array_sort("tokens").alias("tokens"))
    mine = mine.withColumn("q", F.md5(F.to_json(F.struct("own_sig", "tokens")).cast("binary")))
    asked = mine.select("q", "own_sig", "tokens").distinct()
    best = most_alike(asked, held, classes.select("own_sig", "grp"))
    level = classes.select("own_sig", "match_level").distinct()
    out = mine.join(best.withColumnRenamed("id", "best_id"), "q").join(level, "own_sig")
    return out.select(F.col("id").alias("own_id"), "best_id", F.col("match_level").alias("best_level"))

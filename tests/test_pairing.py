"""Best and defensible matches against the assessment of all pairs of a block."""

import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import matching as M
from marketloom.operators import pairing as A
from marketloom.plans import catalog

from .test_plans import SF, plan

COLS = "category string, sub_category string, brand string, item_name string, product_id int, price double"
WORDS = ["fridge", "oven", "split ac", "smart tv", "60cm", "60 cm", "90 l", "200 litres", "12000 btu", "9k btu", "inverter", "non inverter", "built-in", "4 burners", "43 inch", "by acme", "alpha", "beta", "gamma", "delta", "omega", "kappa"]


def products(r, n):
    rows = []
    for i in range(n):
        name = " ".join(r.sample(WORDS, r.randint(0, 7)))
        rows.append(("c", r.choice(["s", "z", "Cooker Hoods"]), r.choice(["Own", "Rival", "Other"]), name, i, float(i)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    df = spark.createDataFrame(products(random.Random(seed), 260), COLS)
    pairs = M.assess_pairs(df, "Own", ["Acme"], ["product_id"]).select(F.col("own.product_id").alias("own_id"), F.col("other.product_id").alias("other_id"), "match_level", "matches", "name_score")
    pairs = pairs.cache()
    want = sorted(map(tuple, M.best_candidates(pairs).collect()))
    got = sorted(map(tuple, A.best_matches(df, "Own", ["Acme"]).select("own_id", "best_id", "best_level").collect()))
    assert got == want and len({w[2] for w in want}) == 3
    want = sorted((r.own_id, r.other_id, r.match_level) for r in pairs.where("match_level in ('STRONG_COMPARABLE', 'COMPARABLE')").collect())
    got = A.defensible_pairs(df, "Own", ["Acme"], ["price"]).collect()
    assert sorted((r.own_id, r.other_id, r.match_level) for r in got) == want and want
    assert all(r.own_price == r.own_id and r.other_price == r.other_id for r in got)


def test_empty_and_one_sided(spark):
    df = spark.createDataFrame([("c", "s", "Own", "fridge 90 l", 1, 1.0), (None, "s", "Rival", "fridge 90 l", 2, 1.0), ("c", None, "Rival", "fridge 90 l", 3, 1.0)], COLS)
    for x in (df, df.limit(0)):
        assert A.best_matches(x, "Own", []).count() == 0 and A.defensible_pairs(x, "Own", [], ["price"]).count() == 0


def test_one_block_of_a_hundred_thousand_products(spark):
    """All pairs of this block would be 2.5 thousand million; the signature pairs and candidates are far fewer."""
    i = F.col("id")
    name = F.concat(F.lit("fridge "), F.when(i % 3 == 0, F.concat((i % 977 + 20).cast("string"), F.lit(" litres "))).otherwise(""), F.when(i % 5 == 0, "inverter ").otherwise(""),
                    F.lit("model"), (i % 20011).cast("string"), F.lit(" line"), (i % 701).cast("string"))
    df = spark.range(100_000).select(
        F.lit("c").alias("category"), F.lit("s").alias("sub_category"), F.when(i % 2 == 0, "Own").otherwise("Rival").alias("brand"), name.alias("item_name"), i.cast("int").alias("product_id"), i.cast("double").alias("price")
    )
    out = A.best_matches(df, "Own", []).cache()
    assert out.count() == 50_000 and out.select("own_id").distinct().count() == 50_000
    # a sample of own products against all rivals, by plain Python sets
    rows = {r.product_id: r for r in df.join(out, df.product_id == out.own_id, "left").collect()}
    rivals = [(k, set(r.item_name.split()), "litres" in r.item_name and r.item_name.split()[1], "inverter" in r.item_name) for k, r in rows.items() if r.brand == "Rival"]

    def rank(mine, other):
        _, words, litres, inverter = other
        matches = (bool(mine[2]) and mine[2] == litres) + (mine[3] and inverter)
        # the words that count: of three letters or more
        a, b = ({w for w in s if len(w) >= 3} for s in (mine[1], words))
        return (4 if matches >= 2 else 3 if matches else 2, matches, len(a & b) / len(a | b), -other[0])

    for k in (0, 2, 30, 4998, 5000, 77770):
        r = rows[k]
        mine = (k, set(r.item_name.split()), "litres" in r.item_name and r.item_name.split()[1], "inverter" in r.item_name)
        assert r.best_id == -max(rank(mine, o) for o in rivals)[3]


@pytest.mark.parametrize("name", ["x5", "w6", "x12", "x8"])
def test_plans_have_no_block_join(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("find", [lambda df: A.defensible_pairs(df, "Own", ["Acme"], ["price"]), lambda df: A.best_matches(df, "Own", ["Acme"])])
def test_no_pattern_runs_in_the_tasks_that_read_the_products(spark, monkeypatch, find):
    """A filter by brand conflict before the profiles are written is pushed below their spread, to the one task of a small file."""
    plans, numbered = [], A.numbered
    monkeypatch.setattr(A, "numbered", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or numbered(df, label))
    df = spark.createDataFrame([*products(random.Random(7), 60), ("c", "s", "Own", "fridge 90 l by acme", 60, 1.0)], COLS)
    got = find(df).collect()
    assert got and 60 not in {r.own_id for r in got}
    assert len(plans) == 1 and "RLIKE" not in plans[0].split("Exchange", 1)[1] and "RLIKE" in plans[0]


def test_features_cast_matched_text_only(spark):
    """A cast of '' that fails costs more than the pattern that found nothing."""
    plan = spark.createDataFrame([("x",)], "t string").select(M.product_features(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "cast(regexp_extract(" not in plan and "cast(nullif(regexp_extract(" in plan

"""Branches that the generated tables do not reach, on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.functions import taxonomy as X
from marketloom.functions import dates as X_dates
from marketloom.functions import text as T
from marketloom.operators import catalogue as C
from marketloom.operators import dedup as D
from marketloom.operators import matching as M
from marketloom.operators import news as N
from marketloom.operators import prices as P
from marketloom.operators import quality as Q
from marketloom.operators import reports as R
from marketloom.operators import signals as G
from marketloom.sources import tables as S
from marketloom.streaming import jobs as Z

D1, D2, D3, D4 = (dt.date(2026, 9, i) for i in (1, 2, 3, 4))


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema or "x string").select(column.alias("v")).first()["v"]


def price_rows(spark, rows):
    return spark.createDataFrame(rows, "observation_id long, competitor_id long, brand string, model string, product_name string, price_kes double, observed_date date")


def test_movements(spark):
    rows = [
        (1, 1, "Acme", "M1", "Fridge", 100.0, D1), (2, 1, " acme ", "m1", "FRIDGE", 110.0, D2), (3, 1, "Acme", "M1", "Fridge", 120.0, D2),
        (4, 1, "Acme", "M1", "Fridge", 120.0, D3), (5, 1, "Acme", "M1", "Fridge", 90.0, D4), (6, 1, "Acme", "", "Fridge", 5.0, D4),
        (7, 2, "Acme", "M1", "Fridge", 7.0, D1), (8, 3, "Acme", "M9", "Oven", 0.0, D1), (9, 3, "Acme", "M9", "Oven", 50.0, D2), (10, 3, "Acme", "M9", "Oven", None, D3),
    ]
    got = {(r["competitor_id"], r["observed_date"]): (r["previous_price"], r["current_price"], r["change"], r["pct"]) for r in P.detect_movements(price_rows(spark, rows)).collect()}
    assert got == {(1, D2): (100.0, 120.0, 20.0, 20.0), (1, D4): (120.0, 90.0, -30.0, -25.0), (3, D2): (0.0, 50.0, 50.0, None)}
    assert [r["competitor_id"] for r in P.ambiguous_identities(price_rows(spark, rows)).collect()] == [1]
    again = P.detect_movements(price_rows(spark, rows[::-1]).repartition(3)).collect()
    assert len(again) == 3


def test_price_signals_gate(spark):
    rows = [(1, 1, "A", "M", "P", 100.0, D1), (2, 1, "A", "M", "P", 120.0, D2)]
    m = P.detect_movements(price_rows(spark, rows))
    assert G.price_signals(m, P.ambiguous_identities(price_rows(spark, rows))).count() == 1
    twice = price_rows(spark, [*rows, (3, 2, "B", "M", "P", 1.0, D1), (4, 2, "B", "M", "P", 2.0, D1)])
    assert G.price_signals(m, P.ambiguous_identities(twice)).count() == 0


def test_concurrency_bounds(spark):
    m = spark.createDataFrame([(1, D1, D3)], "competitor_id long, previous_date date, observed_date date")
    c = spark.createDataFrame(
        [(1, 1, None, None), (2, 1, None, D1), (3, 1, D4, None), (4, 1, D3, None), (5, 1, D1, D4), (6, 2, D1, D4), (7, 1, D2, D2)],
        "campaign_id long, competitor_id long, start_date date, end_date date",
    )


def test_overlaps_of_any_competitor(spark):
    m = spark.createDataFrame([(1, D1, D3), (2, D2, D2)], "competitor_id long, previous_date date, observed_date date")
    c = spark.createDataFrame(
        [(1, 1, None, None), (2, 1, None, D1), (3, 1, D4, None), (4, 3, D3, None), (5, None, D1, D4), (6, 2, D3, D2), (7, 1, D2, D2), (8, 3, D4, D4)],
        "campaign_id long, competitor_id long, start_date date, end_date date",
    )
    got = sorted((r["competitor_id"], r["campaign_id"]) for r in P.overlapping_campaigns(m, c).collect())
    assert got == [(1, 2), (1, 4), (1, 5), (2, 5), (2, 7)]


def test_previous_price_tie(spark):
    rows = [(1, 1, "A", "M", "P", 1.0, D1), (2, 1, "A", "M", "P", 2.0, D1), (3, 1, "A", "M", "P", 3.0, D2)]
    got = {r["observation_id"]: r["previous_price"] for r in P.previous_price(price_rows(spark, rows), ["model"]).collect()}
    assert got == {1: None, 2: None, 3: 2.0}


def test_campaign_status_and_activity(spark):
    rows = [(1, None, None), (2, D1, None), (3, None, D4), (4, D3, D4), (5, D1, D1)]
    df = spark.createDataFrame(rows, "id long, start_date date, end_date date")
    active = {r["id"] for r in df.where(S.active_on(F.lit("2026-09-02").cast("date"))).collect()}
    assert active == {2, 3}
    status = {r["id"]: r["s"] for r in df.select("id", G.campaign_status("2026-09-02").alias("s")).collect()}
    assert status == {1: None, 2: "active", 3: "active", 4: "upcoming", 5: "ended"}


def test_null_safe_insert_is_idempotent(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", 1)], "k string, d int")
    first = D.insert_if_absent(spark.createDataFrame([], "k string, d int"), rows, ["k", "d"])
    assert first.count() == 2
    assert D.insert_if_absent(first, rows, ["k", "d"]).count() == 0


def test_upsert_twice(spark):
    stored = spark.createDataFrame([("x", D2, D2)], "k string, first_seen_date date, last_seen_date date")
    new = spark.createDataFrame([("x", D1), ("x", D4), ("y", D3)], "k string, observed_date date")
    once = D.upsert_seen(stored, new, ["k"])
    want = {("x", D1, D4), ("y", D3, D3)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in D.upsert_seen(once, new, ["k"]).collect()} == want


def test_get_or_create(spark):
    stored = spark.createDataFrame([(5, "a", None, 1.0)], "id long, k string, d date, v double")
    new = spark.createDataFrame([("a", None, 2.0), ("b", D1, 3.0), ("c", D1, 4.0)], "k string, d date, v double")
    got = {r["k"]: (r["id"], r["v"]) for r in D.get_or_create(stored, new, ["k", "d"], "id", ["v"]).collect()}
    assert got["a"] == (5, 2.0)
    assert sorted(got[k][0] for k in "bc") == [6, 7]


def test_merge_categories(spark):
    rows = [("M1", "n", "B", "2"), ("", "n", "A", "1"), ("m1", "x", "A", "3")]
    df = spark.createDataFrame(rows, "model string, product_name string, category string, ord string")
    got = {r["key"]: (r["categories"], r["model"]) for r in D.merge_categories(df, D.coalesced_key(df, "model", "product_name"), "ord").collect()}
    assert got == {"0:m1": ("A,B", "M1"), "1:n": ("A", None)}


def test_merge_offers(spark):
    rows = [
        (1, "S1", "u1", "a", 100.0, None, False), (2, "S1", "u2", "a", 110.0, 90.0, False), (3, "S1", "u2", "a", 50.0, 10.0, True),
        (4, None, "u9", "b", 70.0, None, False), (5, None, "u9", "c", 60.0, None, False), (6, None, None, "d", None, 5.0, True),
    ]
    df = spark.createDataFrame(rows, "ord int, sku string, url string, product_name string, regular_price double, sale_price double, is_sale boolean")
    got = {r["key"]: tuple(r)[1:] for r in D.merge_offers(df, "ord").collect()}
    assert got == {"sku:S1": (110.0, 90.0, True, "S1"), "url:u9": (70.0, None, False, None), "name:d": (None, 5.0, True, None)}


def test_numbers_follow_the_order(spark):
    rows = [(f"m{i % 3}" if i % 11 else None, i * 7 % 100, i) for i in range(200)]
    out = D.number_in_order(spark.createDataFrame(rows, "g string, a int, b int"), "g", ["a", "b"], "n", 30).collect()
    for g in ("m0", "m1", "m2", None):
        own = sorted(((r["a"], r["b"]), r["n"]) for r in out if r["g"] == g)
        assert [n for _, n in own] == list(range(1, len(own) + 1)) and own


def test_one_large_month_is_numbered_by_many_tasks(spark):
    """Nine tenths of the rows in one month, all with one first column: ranges stay small."""
    df = spark.range(60_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("g"), F.lit(1).alias("a"), F.col("id").alias("b"))
    out = D.number_in_order(df, "g", ["a", "b"], "n", 5000)
    assert out.where("g = 99").agg(F.max("n"), F.count_distinct("n")).first() == (54_000, 54_000)
    plan_rows = spark.read.parquet(*[p for p in out.inputFiles()]).groupBy("_b").count().agg(F.max("count"), F.count("*")).first()
    assert plan_rows[0] <= 3 * 5000 and plan_rows[1] >= 10


def test_scalars(spark):
    v = lambda c: one(spark, c, x="a")
    assert v(T.parse_price(F.lit("KSh 12,345.50 only"))) == 12345.5
    assert v(T.parse_price(F.lit("call us"))) is None
    assert v(T.currency_prices(F.lit("KSh 1,500 then KES 1500 or KSh 90 and Kshs 2,000"), 1000, 5e6)) == [1500.0, 2000.0]
    assert v(T.parse_metric(F.lit("1,234 likes"))) == 1234
    assert v(T.canonical_url(F.lit("HTTPS://WWW.Site.com?q=1#x"))) == "https://www.site.com/?q=1"
    assert v(T.url_identity(F.lit("http://www.site.com/a/b/"))) == "site.com/a/b"
    assert v(T.redirect_target(F.lit("https://r.com/?u=https%253A%252F%252Fa.com"))) == "https://a.com"
    assert v(T.pct_change(F.lit(0.0), F.lit(1.0))) is None
    assert v(T.iso_week(F.lit("2027-01-01").cast("date"))) == "2026-W53"
    assert str(v(T.parse_datetime(F.lit("Thu, 12 Mar 2026 10:00:00 +0300")))) == "2026-03-12 07:00:00"
    assert str(v(T.parse_datetime(F.lit("12 March 2026")))) == "2026-03-12 00:00:00"
    assert v(T.clean_article(F.lit("A&amp;B â€œxâ€\x9d  y\n\n\n\nz"))) == 'A&B "x" y\n\nz'
    assert v(T.drop_repeated_tail(F.lit("a\na\nb\nc\nb\nc"))) == "a\nb\nc"
    assert v(T.summarize(F.lit("Short. This sentence is long enough to be kept here. Subscribe now for everything."))) == "This sentence is long enough to be kept here."
    assert v(T.truncate_words(F.lit("alpha beta gamma"), 11)) == "alpha beta"


def test_taxonomy(spark):
    kind = lambda s, raw="": one(spark, X.classify(F.lit(s), F.lit(raw)), x="a")
    assert kind("Side-by-side fridge 500L")["sub_category"] == "Side by Side"
    assert kind("Microwave with dishwasher").method == "conflict" and kind("Microwave with dishwasher").reason == "conflict: Cooking / Microwaves (name); Laundry & Dishwashing / Dishwashers (name)"
    assert kind("Gift card").method == "none" and kind("Clearance sale").method == "text_pattern"
    assert kind("Kettle, microwave and TV").category == "Multi-category"
    assert tuple(kind("microwave with fan")) == ("Cooking", "Microwaves", "high", "mapped", "name", "")  # a weak hit beside a specific one
    assert tuple(kind("tower fan"))[:3] == ("Air & Climate", "Fans", "high") and tuple(kind("big freezer"))[:3] == ("Refrigeration", "Refrigeration - other", "medium")
    assert one(spark, X.model_from_title(F.lit("Fridge AB-120X white")), x="a") == "AB-120X"
    assert one(spark, X.model_from_title(F.lit("Fridge model: zz9-1")), x="a") == "ZZ9-1"
    assert one(spark, X.model_present(F.lit("buy ab120 now"), F.lit("AB120/XY9")), x="a") is True


def levels(spark, rows, brands=()):
    cols = "category string, sub_category string, brand string, item_name string, product_id int"
    df = spark.createDataFrame(rows, cols)
    a = M.assess_pairs(df, "Own", list(brands), ["product_id"]).select(F.col("own.product_id").alias("own_id"), F.col("other.product_id").alias("other_id"), "match_level", "matches", "name_score", "hard")
    return a, {(r["own_id"], r["other_id"]): (r["match_level"], list(r["hard"])) for r in a.collect()}


def test_match_levels(spark):
    own = "12000 btu inverter air conditioner"
    others = ["12K inverter split air", "9,000 BTU split AC", "12000 btu air conditioner by Acme", "200 litres fridge", "12000 btu non-inverter air conditioner", "air conditioner", "mystery"]
    rows = [("c", "s", "Own", own, 0)] + [("c", "s", "Rival", o, i + 1) for i, o in enumerate(others)] + [("c", "z", "Rival", own, 99)]
    _, got = levels(spark, rows, ["Acme"])
    assert {k[1]: v[0] for k, v in got.items()} == {
        1: "STRONG_COMPARABLE", 2: "NO_DEFENSIBLE_MATCH", 3: "NO_DEFENSIBLE_MATCH", 4: "NO_DEFENSIBLE_MATCH", 5: "NO_DEFENSIBLE_MATCH", 6: "TYPE_ONLY", 7: "NO_DEFENSIBLE_MATCH",
    }
    assert got[0, 2][1] == ["BTU_CAPACITY_CONFLICT"] and got[0, 4][1] == ["PRODUCT_FAMILY_CONFLICT:AIR_CONDITIONER!=REFRIGERATOR"] and got[0, 5][1] == ["INVERTER_CONFIGURATION_CONFLICT"]
    # Own side names another brand; litres differ without a hard conflict; equal litres decide for fridges, not for ovens.
    _, got = levels(spark, [("c", "s", "Own", "fridge by acme 90 l", 0), ("c", "s", "Own", "fridge 90 l", 1), ("c", "s", "Own", "oven 90 l", 2), ("c", "s", "Rival", "fridge 90 litres", 3), ("c", "s", "Rival", "freezer 95l", 4), ("c", "s", "Rival", "oven 90l", 5)], ["ACME"])
    assert [got[k][0] for k in ((0, 3), (1, 3), (1, 4), (2, 5))] == ["NO_DEFENSIBLE_MATCH", "COMPARABLE", "TYPE_ONLY", "TYPE_ONLY"]
    # Width alone does not count in two sub-categories, elsewhere it does.
    _, got = levels(spark, [("c", s, b, "60 cm gas cooker", i) for i, (s, b) in enumerate([("Cooker Hoods", "Own"), ("Cooker Hoods", "Rival"), ("Stoves", "Own"), ("Stoves", "Rival")])])
    assert {k: v[0] for k, v in got.items()} == {(0, 1): "TYPE_ONLY", (2, 3): "COMPARABLE"}


def test_best_candidate(spark):
    names = ["fridge 90 l built-in alpha beta", "fridge 90 l alpha", "fridge 90 l alpha beta", "fridge", "oven"]
    rows = [("c", "s", "Own", "fridge 90 l alpha beta", 0), ("c", "s", "Own", "thing", 9)] + [("c", "s", "Rival", n, i + 1) for i, n in enumerate(names)]
    a, _ = levels(spark, rows)
    assert [tuple(r) for r in M.best_candidates(a).collect()] == [(0, 3, "COMPARABLE")]
    a, _ = levels(spark, [r for r in rows if r[4] in (0, 4, 5)])
    assert [tuple(r) for r in M.best_candidates(a).collect()] == [(0, 4, "TYPE_ONLY")]


def test_price_verdicts(spark):
    cases = [([], [], [], "BRAND_OFFICIAL"), ([], [], [], "RETAIL"), ([9], [8], [8, 9], "BRAND_OFFICIAL"), ([], [8], [8], "RETAIL"), ([9], [], [9], "RETAIL"), ([], [], [7], "BRAND_OFFICIAL"), ([1, 2], [3], [1, 2, 3], "RETAIL"), ([1, 2], [], [1, 2], "RETAIL")]
    df = spark.createDataFrame(cases, "r array<int>, s array<int>, n array<int>, t string")
    got = [r["v"] for r in df.select(M.evidence_verdict(F.col("r"), F.col("s"), F.col("n"), F.col("t")).alias("v")).collect()]
    assert got == ["PRICE_NOT_EXPOSED_OFFICIAL_SOURCE", "PRICE_NOT_FOUND", "VERIFIED_OFFICIAL_SALE", "VERIFIED_RETAIL_PROMOTIONAL_PRICE", "VERIFIED_RETAIL_PRICE", "VERIFIED_OFFICIAL_PRICE", "MULTIPLE_PRICE_CANDIDATES", "MULTIPLE_PRICE_CANDIDATES"]
    assert set(got[2:6]) <= set(M.USABLE)


def test_news_rules(spark):
    def read(title, body, entities, products, local):
        row = spark.createDataFrame([(title, body, entities, products, local)], "t string, b string, e array<string>, p array<string>, l array<string>")
        row = row.withColumn("k", N.news_type(N.subject_text(F.col("t"), F.col("b")), F.col("e"))).withColumn("s", N.scope(F.col("e"), F.col("p"), F.col("l"), F.col("k")))
        c = N.confidence(F.col("t"), F.col("b"), F.lit(True), F.lit("https://x/y"), F.col("e"), F.col("p"), F.col("s.status"))
        r = row.select("k", "s.status", "s.reason", c.alias("c")).first()
        return r["k"], r["status"], r["reason"], r["c"]

    long = "x" * 1000
    assert read("A joint  venture", "", ["LG"], [], []) == ("PARTNERSHIP", "IN_SCOPE", "TRACKED_ENTITY", "MEDIUM")
    assert read("New outlet", long, ["LG"], ["tv"], ["n"]) == ("DISTRIBUTION", "IN_SCOPE", "TRACKED_ENTITY_WITH_MARKET_ACTIVITY", "HIGH")
    assert read("Enters", long, ["LG"], [], [])[0] == "EXPANSION" and read("Roadshow", "", ["LG"], [], [])[0] == "COMPANY_DEVELOPMENT"
    assert read("Partners meet", "", [], ["tv"], ["n"])[:3] == ("INDUSTRY_NEWS", "IN_SCOPE", "LOCAL_PRODUCT_MARKET")
    assert read("Demand", "", [], [], ["n"]) == ("MARKET_DEVELOPMENT", "REVIEW", "LOCAL_MARKET_NO_PRODUCT_SIGNAL", "LOW")
    assert read("Rain", "", [], [], ["n"])[1:3] == ("REVIEW", "LOCAL_REFERENCE_REQUIRES_MARKET_RELEVANCE_REVIEW")
    assert read("Rain", "y" * 801 + " market", [], ["tv"], [])[:3] == ("INDUSTRY_NEWS", "OUT_OF_SCOPE", "NO_RELEVANT_MARKET_SIGNAL")
    ask = lambda q, i, a, n, c: one(spark, R.needs_research(F.lit(q), F.lit(i), F.lit(a), F.lit(n), F.lit(c)), x="a")
    assert [ask("latest market today?", "CAMPAIGNS", "yes", 2, "LOW"), ask("please Search the Web", "CAMPAIGNS", "yes", 2, "HIGH"), ask("q", "GENERAL", "yes", 2, "HIGH")] == [False, True, True]
    assert [ask("q", "CAMPAIGNS", " ", 2, "HIGH"), ask("q", "CAMPAIGNS", "a", 0, "MEDIUM"), ask("q", "CAMPAIGNS", "a", 0, "HIGH")] == [True, True, False]


def test_campaign_signals_and_alerts(spark):
    rows = [(1, 1, "A", "VERIFIED", "active", "HIGH"), (2, 1, None, "VERIFIED", "upcoming", "HIGH"), (3, 2, "A", "PENDING", "active", "MEDIUM")]
    c = spark.createDataFrame(rows, "campaign_id long, competitor_id long, category string, verification_status string, status string, confidence string").withColumn("campaign_name", F.lit("Sale"))
    got = {r["signal_type"]: (r["subject"], r["evidence_count"], r["confidence"]) for r in G.campaign_signals(c).collect()}
    assert got == {"CAMPAIGN_ACTIVITY": (None, 3, "MEDIUM"), "MULTI_COMPETITOR_CAMPAIGN": (None, 3, "MEDIUM"), "CAMPAIGN_CATEGORY_CONCENTRATION": ("A", 2, "MEDIUM")}
    first = {r["signal_type"]: r["confidence"] for r in G.campaign_signals(c.where("competitor_id = 1")).collect()}
    assert first == {"CAMPAIGN_ACTIVITY": "HIGH", "CAMPAIGN_CATEGORY_CONCENTRATION": "HIGH"} and G.campaign_signals(c.where("false")).count() == 0
    assert sorted((r["priority"], r["title"]) for r in G.campaign_alerts(c).collect()) == [("MEDIUM", "Sale - ACTIVE"), ("MEDIUM", "Sale - UPCOMING")]
    assert {r["alert_type"]: r["priority"] for r in G.signal_alerts(G.campaign_signals(c)).collect()} == {"MULTI_COMPETITOR_CAMPAIGN": "HIGH", "CAMPAIGN_CATEGORY_CONCENTRATION": "MEDIUM"}


def test_history(spark):
    rows = [(1, D1, D1), (2, dt.date(2026, 8, 1), D1), (3, dt.date(2026, 8, 1), dt.date(2026, 8, 20)), (4, None, D1), (5, dt.date(2026, 8, 1), None)]
    got = {r["k"]: r["presence"] for r in C.historical_presence(spark.createDataFrame(rows, "k int, first_seen_date date, last_seen_date date"), ["k"]).collect()}
    assert got == {1: "INSUFFICIENT_HISTORY", 2: "CURRENTLY_OBSERVED", 3: "POSSIBLE_DISCONTINUATION", 4: "INSUFFICIENT_HISTORY", 5: "INSUFFICIENT_HISTORY"}


def test_price_alert_tiers(spark):
    rows = [(1, "A", D1, x) for x in (4.9, 5.0, -20.0, None)]
    got = [r["priority"] for r in G.price_alerts(spark.createDataFrame(rows, "competitor_id long, id_model string, observed_date date, pct double")).collect()]
    assert got == ["LOW", "MEDIUM", "HIGH", "MEDIUM"]


def test_unique_resolution(spark):
    comp = spark.createDataFrame([(1, "One", "X"), (2, "Two", "X"), (3, "Three", "Y")], "competitor_id long, competitor_name string, brand_name string")
    rows = spark.createDataFrame([("a", "ONE", None), ("b", None, "x"), ("c", None, "y"), ("d", None, None)], "k string, name string, brand string")
    assert {r["k"]: r["competitor_id"] for r in G.resolve_unique(rows, comp).collect()} == {"a": 1, "b": None, "c": 3, "d": None}


def test_campaign_fields(spark):
    fields = lambda text, day="2026-09-20", **k: one(spark, G.campaign_fields(F.lit(text), F.lit(day).cast("date"), **k), x="a")
    c = fields("FLASH SALE! 20% off cookers, 5% discount, 20% off until 28th September")
    assert (c.type, c.name, c.category, c.offer, c.strong) == ("flash_sale", "Flash Sale", "Cooking", "20% off, 5% discount", False)
    assert (c.start_date, str(c.end_date)) == (None, "2026-09-28")
    c = fields("Monthly offers: cookers")
    assert (c.type, c.name, c.category, c.strong) == ("promotion", "Monthly Offers", "General Appliances", True)
    c = fields("Zero-cost financing and a flash sale")
    assert (c.type, c.name, c.category, c.offer) == ("financing", None, None, "100% financing")  # a name comes from the type only for flash sales
    assert fields("Gala with contest", names=[(["gala"], "Gala")]).name == "Gala" and fields("good morning").type is None


@pytest.mark.parametrize(
    "text, span",
    [
        ("25th to 27th September", ("2026-09-25", "2026-09-27")), ("22nd Sept - 7th Oct", ("2026-09-22", "2026-10-07")), ("Friday 25th and Sunday 27th September", ("2026-09-25", "2026-09-27")),
        ("22nd Sept – 7th Oct 2025", ("2025-09-22", "2025-10-07")), ("Dec 28 to Jan 4", ("2026-12-28", "2027-01-04")), ("28 Dec to 4 Jan 2026", ("2025-12-28", "2026-01-04")), ("only on 28th of September!", ("2026-09-28", "2026-09-28")),
        ("from 3 May 2027", ("2027-05-03", None)), ("ends March 3, 2027", (None, "2027-03-03")), ("Jan 5", ("2027-01-05", "2027-01-05")), ("31st June", None), ("tonight", None), (None, None), ("maybe 5 maybe 7", None), ("September 25 - 27", ("2026-09-25", "2026-09-27")),
        ("30 feb to 2 march then 4 june", None),  # the first day that is named is none
    ],
)
def test_date_spans(spark, text, span):
    got = one(spark, X_dates.date_span(F.lit(text).cast("string"), F.lit("2026-09-20").cast("date")), x="a")
    assert (got and tuple(v and str(v) for v in got)) == span


def test_campaign_candidates_and_their_merge(spark):
    rows = [
        (1, 5, "2026-09-21", "u5", "clearance sale of fridges until 3 oct"), (1, 3, "2026-09-21", "u3", "Clearance Sale! 10% off"), (1, 9, "2026-09-20", None, "clearance sale: laundry from 18 sept, special prices"),
        (1, 4, "2026-09-22", "u4", "giveaway today"), (2, 6, "2026-09-22", "u6", "flash sale without evidence"), (2, 7, "2026-09-22", "u7", "sale extended"), (3, 8, "2026-09-22", "u8", "live demo, flash sale, cookers 1 oct"), (3, 2, "2026-09-23", "u2", "live demo, flash sale, microwave"),
    ]
    posts = spark.createDataFrame(rows, "competitor_id long, observation_id long, published_date string, post_url string, post_text string").withColumn("published_date", F.to_date("published_date"))
    found = G.campaign_candidates(posts, F.col("post_text"), "2026-09-25")
    assert sorted(r.observation_id for r in found.collect()) == [2, 3, 5, 8, 9]  # the others lack a name, evidence or both
    got = {r.competitor_id: r for r in G.merge_candidates(found, "2026-09-25").collect()}
    r = got[1]
    assert (r.campaign_name, r.posts, str(r.start_date), str(r.end_date), r.status, r.offer_value, r.category, r.source_url) == ("Clearance Sale", 3, "2026-09-18", "2026-10-03", "active", "Special prices", "General Appliances", "u3")
    r = got[3]
    assert (r.campaign_name, r.posts, str(r.start_date), r.status, r.category, r.source_url, str(r.observed_date)) == ("Flash Sale", 2, "2026-10-01", "upcoming", "Cooking", "u8", "2026-09-23")


def test_launch_evidence(spark):
    cases = [("We launch it", True, "CONFIRMED_LAUNCH"), ("We launch it", False, "FIRST_OBSERVED"), ("introducing", False, "LAUNCH_CANDIDATE"), ("introducing", None, "LAUNCH_CANDIDATE"), ("New arrival", True, "LAUNCH_CANDIDATE"), (None, True, "FIRST_OBSERVED")]
    df = spark.createDataFrame(cases, "t string, official boolean, want string")
    assert all(r.want == r.got for r in df.select("want", C.launch_evidence(F.col("t"), F.col("official")).alias("got")).collect())


def test_provider_payload(spark):
    flat = '{"posts": [{"url": "u1", "text": "t1", "likes": 3}]}'
    nested = '{"data": [{"details": {"post_link": "u2", "comments_count": 1}, "values": {"text": "t2"}, "reactions": {"total_reaction_count": 9}}]}'
    got = {r["post_url"]: (r["post_text"], r["likes"], r["comments"]) for r in S.provider_posts(spark.createDataFrame([(flat,), (nested,), ("{}",), (None,)], "payload string")).collect()}
    assert got == {"u1": ("t1", 3, None), "u2": ("t2", 9, 1)}


def test_article_texts_by_brute_force():
    """Tail repeats and summaries against direct statements of their rules."""
    import random

    rng = random.Random(3)
    for _ in range(300):
        paragraphs = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        got = T._tail(paragraphs)
        once = [p for i, p in enumerate(paragraphs) if not i or p != paragraphs[i - 1]]
        assert got == once[: len(got)]
        assert not any(len(got) >= 2 * n and got[-n:] == got[-2 * n : -n] for n in range(1, 6))
        assert len(got) == len(once) or any(once[len(got) :][:n] == got[-n:] for n in range(1, 6))
    said = ["Short one.", "A sentence of more than thirty characters here!", "Another sentence that is long enough to be taken.", "Please subscribe to our long letter of the week.", "Never reached sentence of a good length, really."]
    assert T._summary(" ".join(said)) == " ".join(said[1:3])
    assert len(T._summary(" ".join(said[1:3] * 40))) <= 500 and T._summary(None) == "" and T._summary("x" * 900) == "x" * 900
    assert T._clean("&lt;b&gt; it\u2019s  fine\n\n\n\nﬁ") == "<b> it's fine\n\nfi" and T._clean(None) == ""


def test_news(spark):
    assert one(spark, N.terms_in(F.lit("The LG-made TV"), ["lg", "made tv", "g"]), x="a") == ["lg", "made tv"]
    assert one(spark, N.categories_in(F.lit("fan edition phone"), {"fans": ["fan"]}, "fan edition"), x="a") == []
    assert one(spark, R.question_intent(F.lit("Which campaigns are  ACTIVE?")), x="a") == "CAMPAIGNS_ACTIVE"
    assert one(spark, R.longest_alias(F.lit("show acme north prices"), {"acme": "Acme", "acme north": "Acme North"}), x="a") == "Acme North"


def test_quality_expectation(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n long")
    e = spark.createDataFrame([("x", 1), ("y", 3), ("z", 1)], "k string, n long")
    assert {r["k"]: r["state"] for r in Q.against_expectation(a, e, "k").collect()} == {"x": "OK", "y": "MISMATCH", "z": "MISSING"}


def test_stream_movements_match_batch_and_late_rows(spark, tmp_path):
    rows = [("a", D1, 1, 10.0), ("a", D2, 2, 12.0), ("b", D1, 3, 5.0)], [("a", D2, 9, 11.0), ("a", D1, 10, 99.0), ("b", D3, 4, 5.0)], [("a", D3, 11, 10.0), ("b", D4, 5, 6.0)]
    schema = "identity string, observed_date date, observation_id long, price_kes double"
    path = str(tmp_path / "in")
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    moved, late = Z.movements_by_batch(s)
    got = {(r["identity"], r["observed_date"]): (r["previous_price"], r["current_price"]) for r in moved.collect()}
    assert got == {("a", D2): (10.0, 11.0), ("a", D3): (11.0, 10.0), ("b", D4): (5.0, 6.0)}
    assert [r["observation_id"] for r in late.collect()] == [10]


def test_stream_movements_go_on_after_a_restart(spark, tmp_path):
    batches = [("a", D1, 1, 10.0), ("b", D1, 3, 5.0)], [("a", D2, 9, 11.0)], [("a", D3, 11, 10.0), ("b", D4, 5, 6.0), ("a", D1, 12, 1.0)]
    schema = "identity string, observed_date date, observation_id long, price_kes double"
    path, job = str(tmp_path / "in"), str(tmp_path / "job")
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        s = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
        moved, late = Z.movements_by_batch(s, path=job)  # a new query on the same checkpoint each time
        got = {(r["identity"], r["observed_date"]): (r["previous_price"], r["current_price"]) for r in moved.collect()}
    assert got == {("a", D2): (10.0, 11.0), ("a", D3): (11.0, 10.0), ("b", D4): (5.0, 6.0)}
    assert [r["observation_id"] for r in late.collect()] == [12]


def test_update_mode_keeps_the_last_row_of_a_key(spark, tmp_path):
    path = str(tmp_path / "in")
    for d in (D2, D1, D3):
        spark.createDataFrame([("a", d)], "k string, observed_date date").coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema("k string, observed_date date").option("maxFilesPerTrigger", 1).parquet(path)
    for mode, keys in (("update", ["k"]), ("complete", None)):
        assert [tuple(r) for r in Z.run_to_end(Z.seen_dates(s, ["k"]), mode, keys=keys).select("k", "first_seen_date", "last_seen_date").collect()] == [("a", D1, D3)]


def test_stateful_processor(spark, tmp_path):
    from marketloom.session import ship

    ship(spark)
    path = str(tmp_path / "in")
    schema = "identity string, observed_date date, observation_id long, price_kes double"
    spark.createDataFrame([("a", D1, 1, 10.0), ("a", D2, 2, 12.0), ("a", D2, 3, 10.0), ("a", D3, 4, 9.0)], schema).coalesce(1).write.parquet(path)
    s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    with Z.state_store(spark):
        out = Z.run_to_end(Z.live_movements(s), "update")
    assert [(r["observed_date"], r["previous_price"], r["current_price"]) for r in out.collect()] == [(D3, 10.0, 9.0)]


def test_mentions_of_any_name(spark):
    names = ["Acme", "Warm Stone East Coast", "O'Neil & Co.", "Jet-Line", "Café Nilo", "caf", "北京", "a.b\\E(", " "]
    aliases = spark.createDataFrame([(n,) for n in names], "alias string")
    texts = ["does WARM STONE east coast beat acme?", "o'neil & co. and jet-line", "jet line, acmes, o neil & co", "café nilo 北京", "a.b\\e( x", "", None]
    got = R.mentions(spark.createDataFrame(list(enumerate(texts)), "id long, q string"), "q", aliases).collect()
    want = {(0, "Acme"), (0, "Warm Stone East Coast"), (1, "O'Neil & Co."), (1, "Jet-Line"), (3, "Café Nilo"), (3, "caf"), (3, "北京"), (4, "a.b\\E(")}
    assert sorted((r["id"], r["alias"]) for r in got) == sorted(want)


def test_header_and_children_are_read_from_numbered_rows(spark):
    """Observations are numbered once, not again for the header and each child."""
    df = spark.createDataFrame([(i, 1, "b", "m", dt.date(1998, 1 + i % 2, 3), float(i), "price" if i % 2 else "news") for i in range(9)],
        "observation_id long, competitor_id long, brand string, model string, observed_date date, price_kes double, finding_type string")
    head, child = S.split_header_children(df, spark.createDataFrame([], "month string, last int"), {"price": ["price_kes"], "news": ["brand"]})
    for d in (head, *child.values()):
        assert "Window" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert head.count() == 9 and {k: d.count() for k, d in child.items()} == {"price": 4, "news": 5}


def test_plain_identity_text_meets_no_pattern(spark):
    texts = ["a  b", " a b ", "a\tb", "\na", "a\x0bb\f", "a\r\nb", "ab", "", None, " x", " ", "ä  ö"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [tuple(r) for r in df.select(T.identity_text(F.col("t")), F.upper(T.squeeze(F.col("t")))).collect()]
    assert [a for a, _ in got] == [b for _, b in got] and None not in [a for a, _ in got]
    assert "CASE WHEN" in df.select(T.identity_text(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()

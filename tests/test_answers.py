"""Answers to routed questions, on hand-made lines; market context of articles."""

from pyspark.sql import functions as F

from marketloom.functions import text as T
from marketloom.operators import answers as A
from marketloom.operators import news as N

LINES = "intent string, subject string, place string, line string, evidence string, brief string"
ROUTED = "q long, intent string, named string, scope array<string>"


def lines(spark, rows):
    return spark.createDataFrame([(i, s, p, f"line {p}", f"proof {p}", f"brief {p}") for i, s, p in rows], LINES)


def answered(spark, routed, rows):
    return {r["q"]: r for r in A.compose(spark.createDataFrame(routed, ROUTED), lines(spark, rows)).collect()}


def test_scopes_counts_and_texts(spark):
    rows = [("SOCIAL_EVIDENCE", "7", f"{i:03d}") for i in range(12)] + [("SOCIAL_EVIDENCE", None, "500"), ("STRATEGIC_ALERTS", "acme", "a"), ("COMPETITOR_COMPARISON", "7", "c"), ("COMPETITOR_COMPARISON", "8", "d")]
    got = answered(spark, [
        (1, "SOCIAL_EVIDENCE", "Seven", ["7"]), (2, "SOCIAL_EVIDENCE", None, None), (3, "SOCIAL_EVIDENCE", "Nobody", []), (4, "STRATEGIC_ALERTS", "Acme", ["7", "ACME", "acme"]),
        (5, "COMPETITOR_COMPARISON", None, None), (6, "COMPETITOR_COMPARISON", "7 and 8", ["8", "7"]), (7, "UNSUPPORTED", None, None), (8, "SOCIAL_EVIDENCE", "Seven", ["7"]), (9, None, None, None),
    ], rows)
    assert got[1]["n_rows"] == 12 and got[1]["answer"] == "12 social observations were retrieved:\n" + "\n".join(f"- line {i:03d}" for i in range(10)) + "\n- ...and 2 additional."
    assert got[1]["evidence"] == [f"proof {i:03d}" for i in range(10)] and got[8]["answer"] == got[1]["answer"]
    assert got[2]["n_rows"] == 13  # without a scope, lines of nobody count too
    assert (got[3]["n_rows"], got[3]["answer"], got[3]["evidence"]) == (0, "No matching social evidence was retrieved for Nobody.", [])
    assert got[4]["answer"] == "1 open strategic alert were retrieved:\n- line a"
    assert got[5]["answer"] == "No matching competitor comparison records were retrieved." and got[6]["evidence"] == ["proof c", "proof d"]
    assert got[7]["answer"] is None and got[7]["n_rows"] == 0 and got[9]["answer"] is None


def test_activity_is_counted_by_kind(spark):
    rows = [("CAMPAIGNS_ACTIVE", "7", f"{i}") for i in range(7)] + [("MARKET_TRENDS", "7", "t"), ("STRATEGIC_ALERTS", "8", "x"), ("CAMPAIGNS", "7", "unused")]
    got = answered(spark, [(1, "COMPETITOR_ACTIVITY", "Seven", ["7"]), (2, "COMPETITOR_ACTIVITY", "Nine", ["9"])], rows)
    assert got[1]["answer"] == "Current documented activity for Seven:\n- Active campaigns: 7\n- Market-trend records involving this scope: 1"
    assert got[1]["evidence"] == [f"Campaign: brief {i}" for i in range(5)] + ["Trend: brief t"]
    assert got[2]["answer"] == "No current evidence was retrieved for Nine." and got[2]["evidence"] == []


def test_no_lines_and_no_questions(spark):
    assert answered(spark, [], [("CAMPAIGNS", "7", "a")]) == {}
    assert answered(spark, [(1, "CAMPAIGNS", None, None)], [])[1]["answer"] == "No campaigns were retrieved in the current evidence set."


def test_line_texts(spark):
    s = "competitor_id long, campaign_name string, start_date string, end_date string, offer_value string, category string, verification_status string, confidence string, source_url string"
    df = spark.createDataFrame([(7, "Days", "2026-09-01", "2026-09-01", "10%", "TV", "VERIFIED", "HIGH", "u"), (7, None, None, None, None, " ", None, None, "")], s)
    got = sorted((r["line"], r["evidence"]) for r in A.campaign_lines(df, F.lit("")).collect())
    assert got == [
        ("Days (2026-09-01) - 10% - category: TV", "Days: verification=VERIFIED, confidence=HIGH, source=u"),
        ("not recorded (date not recorded)", "not recorded: verification=not recorded, confidence=not recorded, source=not recorded"),
    ]
    s = "competitor_id long, platform string, account_name string, post_text string, published_date string, observed_date string, verification_status string, confidence string"
    df = spark.createDataFrame([(7, "x", "a", "w" * 181, None, "d", "V", "H"), (7, "y", "a", " ", "p", None, "V", "H")], s)
    got = sorted(r["line"] for r in A.social_lines(df, F.lit("")).collect())
    assert got == ["x - d - " + "w" * 177 + "...", "y - not recorded - post text not captured"]


def test_one_subject_may_hold_most_lines(spark):
    """Only counts and first lines of a subject leave the tasks that read them, whatever its share."""
    many = spark.range(200_000).select(F.lit("CAMPAIGNS").alias("intent"), F.when(F.col("id") % 10 < 9, "7").otherwise("8").alias("subject"),
        F.lpad(F.col("id").cast("string"), 9, "0").alias("place"), F.lit("l").alias("line"), F.lit("e").alias("evidence"), F.lit("b").alias("brief"))
    out = A.compose(spark.createDataFrame([(1, "CAMPAIGNS", "Seven", ["7"])], ROUTED), many)
    assert out.first()["n_rows"] == 180_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "CartesianProduct" not in plan


def test_periods(spark):
    rows = [("a", "b"), ("a", "a"), ("a", None), (None, "b"), (None, None), (" ", "")]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, e string").coalesce(1).select(T.period_label(F.col("s"), F.col("e"))).collect()]
    assert got == ["a to b", "a", "a", "b", "date not recorded", "date not recorded"]


def test_market_context(spark):
    rows = [
        ("Acme", "", True, False), ("", None, True, True), ("news", "a Discount today", False, True), ("news", "a discount today", False, False), ("new TV", "for the retailer", False, False),
        ("new TV", "for all", False, False), ("x", "launches", False, False), ("x", "presales", False, True),
    ]
    df = spark.createDataFrame(rows, "t string, b string, brand boolean, cat boolean").coalesce(1)
    some = lambda c: F.when(F.col(c), F.array(F.lit("k")))
    got = [tuple(r) for r in df.select(N.market_context(F.col("t"), F.col("b"), some("brand"), some("cat")).alias("m")).select("m.signals", "m.news_type", "m.relevant").collect()]
    assert got == [
        ([], "market development", True), ([], "market development", False), (["discount"], "promotion", True), (["discount"], "promotion", False),
        (["retailer"], "distribution", True), ([], "market development", False), ([], "product launch", False), ([], "market development", False),
    ]

"""Joins of dates with intervals, and unions of intervals, against plain loops."""

import datetime
import random

from pyspark.sql import functions as F

from marketloom.operators import intervals as I
from marketloom.operators import prices as P
from marketloom.operators import signals as G

from .test_plans import plan

DAY0 = datetime.date(1996, 2, 20)


def day(n):
    return None if n is None else DAY0 + datetime.timedelta(n)


def random_intervals(r, n, span):
    out = []
    for k in range(n):
        a = r.randint(-10, span + 10)
        b = a + r.choice([-1, 0, 1, 7, span])
        out.append((k, r.choice("xyz"), day(a) if r.random() < 0.8 else None, day(b) if r.random() < 0.8 else None))
    return out


def holds(a, b, d):
    return d is not None and not (a is None and b is None) and (a is None or a <= d) and (b is None or d <= b)


def test_interval_join_brute_force(spark):
    r = random.Random(3)
    for span, cell in ((0, 512), (1, 2), (37, 3), (400, 512), (5000, 5)):
        points = [(i, day(r.randint(0, span)) if r.random() < 0.95 else None) for i in range(120)] + [(999, day(span // 2))] * 40
        held = random_intervals(r, 60, span)
        p, h = spark.createDataFrame(points, "id int, d date"), spark.createDataFrame(held, "k int, owner string, a date, b date")
        got = sorted((x.id, x.k) for x in I.interval_join(p, "d", h, "a", "b", cell).collect())
        assert got == sorted((i, k) for i, d in points for k, _, a, b in held if holds(a, b, d))
    assert I.interval_join(p.limit(0), "d", h, "a", "b").count() == 0
    assert I.interval_join(p, "d", h.limit(0), "a", "b").count() == 0


def test_a_node_is_dealt_to_cells(spark):
    """One day with many rows and one long interval many times over: no task sees more than some cells of pairs."""
    p = spark.range(3000).select(F.col("id"), F.lit(DAY0).alias("d"))
    h = spark.range(2000).select(F.col("id").alias("k"), F.lit(day(-5)).alias("a"), F.lit(None).cast("date").alias("b"))
    out = I.interval_join(p, "d", h, "a", "b", cell=500)
    assert out.count() == 6_000_000
    cells = out.select("id", "k").groupBy((F.col("id") * 0).alias("z")).agg(F.count_distinct("id").alias("i"), F.count_distinct("k").alias("k")).first()
    assert (cells.i, cells.k) == (3000, 2000)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_merged_runs_brute_force(spark):
    r = random.Random(4)
    held = random_intervals(r, 80, 200)
    runs = I.merge_runs(spark.createDataFrame(held, "k int, owner string, a date, b date"), ["owner"], "a", "b").collect()
    low, high = datetime.date(1, 1, 1), datetime.date(9999, 12, 31)
    for owner in "xyz":
        own = sorted((x.a, x.b) for x in runs if x.owner == owner)
        assert all((c - b).days > 1 for (_, b), (c, _) in zip(own, own[1:]))
        for n in range(-30, 450):
            want = any(holds(a, b, day(n)) for _, o, a, b in held if o == owner)
            assert any(a <= day(n) <= b for a, b in own) == want
        if any(o == owner and a is None and b is not None for _, o, a, b in held):
            assert own[0][0] == low
        if any(o == owner and b is None and a is not None for _, o, a, b in held):
            assert own[-1][1] == high


def test_concurrency_has_one_signal_for_owner_name_and_movement(spark):
    moves = [("A", "m1", 0, 10), ("A", "m1", 0, 10), ("B", "m2", 5, 40), ("B", "m3", 90, 95)]
    m = spark.createDataFrame([(b, n, day(p), day(o)) for b, n, p, o in moves], "id_brand string, id_model string, previous_date date, observed_date date")
    camps = [(1, 7, "Sale", 0, 5), (2, 7, "Sale", 4, 12), (3, 7, "Sale", 39, None), (4, 8, "Sale", None, 0), (5, 9, "Sale", 0, 99), (6, 8, "Win", None, None)]
    c = spark.createDataFrame([(i, o, n, day(a), day(b)) for i, o, n, a, b in camps], "campaign_id int, competitor_id int, campaign_name string, start_date date, end_date date")
    owners = spark.createDataFrame([(7, "Seven"), (8, "Eight")], "competitor_id int, competitor_name string")
    got = sorted((r.subject, r.title) for r in G.concurrency_signals(m, c, owners).collect())
    assert got == [
        ("Eight", "A m1 and Eight Sale date overlap"), ("Seven", "A m1 and Seven Sale date overlap"),
        ("Seven", "B m2 and Seven Sale date overlap"), ("Seven", "B m3 and Seven Sale date overlap"),
    ]


def test_campaign_pairs_brute_force(spark):
    r = random.Random(5)
    moves = [(i, *sorted((r.randint(0, 60), r.randint(0, 60)))) for i in range(60)]
    held = random_intervals(r, 40, 60)
    m = spark.createDataFrame([(i, day(p), day(o)) for i, p, o in moves], "id int, previous_date date, observed_date date")
    c = spark.createDataFrame([(k, 1, a, b) for k, _, a, b in held], "campaign_id int, competitor_id int, start_date date, end_date date")
    got = sorted((x.id, x.campaign_id) for x in P.overlapping_campaigns(m, c).collect())
    assert got == sorted((i, k) for i, p, o in moves for k, _, a, b in held if holds(a, b, day(p)) or holds(a, b, day(o)))


def test_alerts_find_the_movements_once(spark, monkeypatch):
    from marketloom.plans import bind, q_signals

    calls, find = [], P.detect_movements
    monkeypatch.setattr(P, "detect_movements", lambda prices: calls.append(1) or find(prices))
    out = q_signals.alerts(bind.Tables(spark, "/root/testdata/sf0.001"))
    assert len(calls) == 1 and "lineitem" not in plan(out.where("alert_type in ('PRICE_MOVEMENT', 'PRICE_CAMPAIGN_CONCURRENCY')"))

"""Physical plans: no nested loops, columns pruned, filters pushed to the scan."""

import contextlib
import io

import pytest

from marketloom.plans import bind, catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["w1", "j5", "j6", "j7", "j8", "j14", "d4", "d5", "a1", "a8", "k1", "x3", "x5", "l5", "r3"])
def test_no_nested_loop(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_columns_are_pruned(spark):
    text = plan(catalog.QUERIES["w1"](spark, SF))
    assert "l_extendedprice" in text and "l_tax" not in text and "p_retailprice" not in text


def test_filters_reach_the_scan(spark):
    text = plan(catalog.QUERIES["l2"](spark, SF))
    assert "EqualTo(o_orderpriority,1-URGENT)" in text


def test_views_and_frames_agree_on_columns(spark):
    t = bind.Tables(spark, SF)
    for name in ("competitors", "prices", "findings", "runs", "campaigns", "catalogue", "canonical", "social", "news", "questions"):
        assert getattr(t, name).columns

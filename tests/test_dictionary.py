"""Dictionaries and rule tables of any length against plain loops."""

import random
import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from marketloom.functions import dictionary as D
from marketloom.functions import taxonomy as X
from marketloom.operators import news as N

from .test_plans import plan

LETTERS = "ab c-1é"


def whole(term, text):
    return re.search(rf"(^|[^a-z0-9]){re.escape(term.lower())}([^a-z0-9]|$)", text.lower()) is not None


def test_terms_brute_force(spark):
    r = random.Random(8)
    texts = ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 30))) for _ in range(400)] + [None, "", "AB", "ab"]
    lists = {"x": ["a", "ab", "ab c", "", "B-1", "é", "ab"], "y": ["c", "AB"], "z": []}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(3)
    for words in (True, False):
        hit = whole if words else (lambda a, b: a.lower() in b.lower())
        for row in df.select("t", D.found_in_lists(F.col("t"), lists, words).alias("f"), D.labels_in(F.col("t"), lists, words).alias("n")).collect():
            want = {k: [w for w in v if w and hit(w, row.t or "")] for k, v in lists.items()}
            assert row.f.asDict() == want and row.n == [k for k, v in want.items() if v]


def test_table_terms_in_blocks(spark):
    r = random.Random(9)
    words = [f"{r.choice('abcdef')}{r.randint(0, 999)}" for _ in range(500)]
    df = spark.createDataFrame([(i, " ".join(r.sample(words, 12)) + " zz") for i in range(60)], "id int, t string")
    table = spark.createDataFrame([(w,) for w in [*words[:300], "", None]], "word string")
    for limit in (D.BLOCK_BYTES, 9000):
        for row in D.find_table_terms(df, "t", table, "word", limit=limit).collect():
            assert row.terms == sorted(set(row.t.split()) & set(words[:300]))


def test_ten_thousand_terms_leave_the_plan_small(spark):
    terms = [f"term{i}" for i in range(10_000)] + ["the", "license"]
    news = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = news.select("doc_id", N.terms_in(F.coalesce("text", F.lit("")), terms).alias("t"))
    assert len(plan(out)) < 5000
    got = out.agg(F.sum(F.size("t"))).first()[0]
    assert got == sum(news.where(F.lower("text").rlike(rf"(^|[^a-z0-9]){t}([^a-z0-9]|$)")).count() for t in ("the", "license"))


def plain(text, raw, rules, raw_map, slugs):
    """The classification by a loop over all rules."""
    hits = [(r.category, r.sub_category, r.level, "name", r.priority) for r in rules if re.search(r.pattern, text, re.I)]
    if slugs:
        found = [(slugs[x.strip()], "slug") for x in raw.lower().split(",") if x.strip() in slugs]
    else:
        found = [(raw_map[raw.strip().lower()], "raw")] if raw.strip().lower() in raw_map else []
    hits += [(c, s, level, src, 50 if level == "specific" else 5) for (c, s, level), src in found]
    if not hits:
        wide = re.search(X.MANY, text) or raw.strip().lower() in X.UMBRELLAS
        return ("Multi-category", "", "low", "review", "text_pattern") if wide else ("", "", "", "review", "none")
    by = {k: [h for h in hits if h[2] == k] for k in ("specific", "weak", "category")}
    strong = by["specific"] or by["weak"]
    cats = {h[0] for h in strong or by["category"]}
    if strong and len(cats) >= 3:
        return ("Multi-category", "", "low", "review", "multi_category")
    if len(cats) > 1:
        return ("", "", "", "review", "conflict")
    best = max(strong or by["category"], key=lambda h: h[4])
    sources = "+".join(sorted({h[3] for h in strong or by["category"] if not strong or h[1] == best[1]}))
    return (best[0], best[1], "high" if strong else "medium", "mapped", sources)


def test_five_hundred_rules_brute_force(spark):
    r = random.Random(10)
    parts = ["fan", "oven", "kettle", "tv", "door", "gas", "top", "side", "cool", "heat"]
    form = [lambda a, b: a, lambda a, b: rf"\b{a}s?\b", lambda a, b: rf"{a}[ -]?{b}", lambda a, b: rf"{a}|{b}", lambda a, b: rf"(?<!{b} ){a}", lambda a, b: rf"{a} ?{b}\d+"]
    rules = tuple(
        X.CategoryRule(f"C{r.randint(0, 3)}", f"S{r.randint(0, 9)}", r.randint(1, 99), r.choice(form)(r.choice(parts) + str(r.randint(0, 60)), r.choice(parts)), r.choice(["specific", "weak", "category"]))
        for _ in range(500)
    )
    raw_map = {"one": ("C0", "S1", "specific"), "two": ("C9", "C9 - other", "category")}
    slugs = {"s-1": ("C0", "S1", "specific"), "s-2": ("C1", "C1 - other", "category")}
    word = lambda: r.choice(parts) + (str(r.randint(0, 90)) if r.random() < 0.7 else r.choice(["", "s"]))
    rows = [(i, r.choice([" ", "-", ""]).join(word() for _ in range(r.randint(0, 4))) + r.choice(["", " up to 5% off"]), r.choice([" One", "two", "multiple", "x", "s-1, s-2", "S-2"])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, t string, raw string").repartition(3)
    for maps in ((raw_map, {}), (raw_map, slugs)):
        out = df.select("t", "raw", X.classify(F.col("t"), F.col("raw"), rules, *maps).alias("s"))
        assert len(plan(out)) < 20_000
        for row in out.collect():
            assert tuple(row.s)[:5] == plain(row.t, row.raw, rules, *maps), row


def test_null_texts_and_ordered_rules(spark):
    df = spark.createDataFrame([(None, None), ("", "")], "t string, raw string")
    assert [r.s.method for r in df.select(X.classify(F.col("t"), F.col("raw")).alias("s")).collect()] == ["none", "none"]
    rules = (X.OrderedRule("A", "a", ("x", "y"), ("z",), ("q",)), X.OrderedRule("B", "b", (), (), ("n",)), X.OrderedRule("C", "c"))
    got = [tuple(r.s)[:2] for r in spark.createDataFrame([("XZ",), ("yzq",), ("xn",), (None,)], "t string").select(X.assign(F.col("t"), rules).alias("s")).collect()]
    assert got == [("A", "a"), ("B", "b"), ("C", "c"), ("B", "b")]


def test_attribution_follows_the_article(spark):
    cases = [
        (["Acme", "Bolt", "Cold"], "Bolt and cold: a story", "Bolt"), (["Acme", "Cold", "Bolt"], "nothing", "Cold"), (["Acme"], "Acme wins", None), ([], "Bolt", None), (["bolt "], None, "bolt"), (["Cold", "Bolt"], "BOLTED down", "Bolt"),
    ]
    df = spark.createDataFrame(cases, "e array<string>, h string, want string")
    for row in df.select("want", N.attribute(F.col("e"), F.col("h"), ["BOLT", "Cold"]).alias("got")).collect():
        assert row.got == row.want


def test_texts_of_a_batch_are_read_one_by_one(spark, monkeypatch):
    """A batch has up to 10,000 texts; they are not Python strings all at once."""
    taken = []
    monkeypatch.setattr(D.F, "arrow_udf", lambda run, kind: taken.append(run) or (lambda c: c))
    D.found_in_lists(F.lit("x"), {"a": ["alpha"], "b": ["beta"]})
    batch = pa.array([("alpha" if i % 2 else "beta") + " " * 100_000 for i in range(600)])
    tracemalloc.start()
    (got,) = taken[0](iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [{"l0": ["alpha"] if i % 2 else [], "l1": [] if i % 2 else ["beta"]} for i in range(600)]
    assert next(taken[0](iter([pa.array([], pa.string())]))).to_pylist() == []
    assert peak < 20_000_000

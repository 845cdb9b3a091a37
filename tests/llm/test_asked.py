"""Personal data, ranked search, hard negatives."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import negatives, pii, search
from marketloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

# ---------------------------------------------------------------- personal data


def plain(text):
    """The base forms by their patterns as stated."""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    odd = lambda d: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10
    return [
        *((0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)),
        *((1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))),
        *((2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and odd(digits(m[0])) == 0),
        *((3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15),
    ]


TRICKY = [
    "", "a@b", "a@b.c@d.e", "a@@b.c", "x.@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 0.0.0.0", "0000001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (499) 555-6503.",
    "+1 234 567 8 9 10 11 12 13", "++12345678", "+1 (826) 555-4081 190.137.223.204", "ä@b.de é+49 30 1234567", "4111 1111 1111 1111 4111 1111 1111 1111", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
]


def test_base_spans_brute_force():
    r = random.Random(1)
    for text in TRICKY + ["".join(r.choice("ab1.2 @-+()0%9\n") for _ in range(r.randint(0, 60))) for _ in range(5000)]:
        assert pii.base_spans(text) == plain(text), text


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_candidates_are_calibrated(spark, model):
    """On contexts and values that the fit has not seen, taken candidates are right and few are missed."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and doc_id % 3 = 1").select("text").collect()]
    x, y, kinds, _ = pii.examples([t[-400:] for t in texts], seed=99)
    p = model.probability(kinds, model.trees.margin(x))
    taken = p >= model.thresholds[kinds]
    assert np.isfinite(model.thresholds).all()
    assert y[taken].mean() > 0.95 and taken[y == 1].mean() > 0.85


@pytest.mark.parametrize(
    "text, want",
    [
        ("write to mira.kalo at example dot com today", ("email", "mira.kalo at example dot com")),
        ("Contact: jobel [at] mail.example [dot] org now", ("email", "jobel [at] mail.example [dot] org")),
        ("tel: (499) 555-6503 or later", ("phone", "(499) 555-6503")),
        ("iban DE89 3704 0044 0532 0130 00 please", ("account", "DE89 3704 0044 0532 0130 00")),
        ("server 10[.]20[.]30[.]40 was down", ("ip", "10[.]20[.]30[.]40")),
        ("born 1984-03-12 in the town", ("birth", "1984-03-12")),
        ("card 3782 822463 10005 was used", ("card", "3782 822463 10005")),
    ],
)
def test_looser_forms(model, text, want):
    found = pii.detect([text], model)[0]
    assert [(s[0], text[s[2] : s[3]]) for s in found] == [want]


@pytest.mark.parametrize("text", ["we met at home. Then we left", "version 10.2.3 of order 123456789012", "the years 1990-2030 and 12/05/2021", "total 12 345 678 in 2019", "at 10:20:30 the run ended", "commit 1eb9c654e721b4f8"])
def test_look_alikes_stay(model, text):
    assert pii.detect([text], model)[0] == []


def test_private_query_and_edges(spark, model):
    got = {r.doc_id: r for r in QUERIES["op11_personal_data"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        want, r = plain(d.text or ""), got[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in want) for i in range(4)]
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    odd = spark.createDataFrame([(1, None, "k", 1), (1, "a@b.cd", "k", 2), (1, "a@b.cd", "k", 2), (2, "", "k", 3), (None, "x@y.zz and x@y.zz", "k", 4)], "doc_id long, text string, kind string, found int")
    rows = sorted((r.doc_id or 0, len(r.found)) for r in pii.find_private(odd, model).collect())
    assert rows == [(0, 2), (1, 0), (1, 1), (1, 1), (2, 0)]
    assert [(r.kind, r.found, r.text) for r in pii.redact(odd, model).orderBy("found").collect()] == [
        ("k", 1, None), ("k", 2, "[email]"), ("k", 2, "[email]"), ("k", 3, ""), ("k", 4, "[email] and [email]")
    ]
    assert pii.find_private(odd.limit(0), model).count() == 0
    assert pii.fit(odd.limit(0)).trees is not None


@pytest.mark.parametrize("unit", ["a", "1", "1 ", "1.1.", "+1 ", "@", "a@", " at", "(", "1(", "1:", "A", "AB12", "1-", "a."])
def test_scans_are_linear(model, unit):
    began = time.time()
    pii.detect([unit * (200_000 // len(unit))], model)
    assert time.time() - began < 5


# ---------------------------------------------------------------- ranked search


def doc_frame(spark, texts, ids=None):
    rows = [(i, t, 1, "s", "i", 2, 3) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, score string, item_id string, at int, tf int").repartition(3)


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, q int")


def test_search_brute_force_ties_and_edges(spark):
    r = random.Random(4)
    word = lambda: r.choice(["Ab", "cd", "e9", "éa", "日本", "ef", "gh", "ij"])
    texts = [" ".join(word() for _ in range(r.randint(1, 12))) for _ in range(150)] + [None, "", " .,;", "AB, cd!"] * 3 + ["ab cd " * 30_000]
    items = [(1, "ab cd"), (1, "ab cd"), (2, "é éa zz"), (3, None), (4, ""), (5, "ab ab ab 日本"), (5, "ij"), (6, "absent"), (None, "gh")]
    got = sorted(map(tuple, search.rank_documents(doc_frame(spark, texts), items_frame(spark, items)).collect()), key=str)
    want = sorted(search.brute_force(list(enumerate(texts)), items), key=str)
    assert got == want and len({g[0] for g in got}) == 4
    small = sorted(map(tuple, search.rank_documents(doc_frame(spark, texts), items_frame(spark, items), block=60).collect()), key=str)
    assert small == want
    some = search.rank_documents(doc_frame(spark, texts), items_frame(spark, items), k=3)
    assert sorted(map(tuple, some.collect()), key=str) == sorted(search.brute_force(list(enumerate(texts)), items, 3), key=str)
    assert search.rank_documents(doc_frame(spark, texts), items_frame(spark, [])).count() == 0
    assert search.rank_documents(doc_frame(spark, []), items_frame(spark, items)).count() == 0


def test_repeated_documents_are_ranked_one_by_one(spark):
    got = search.rank_documents(doc_frame(spark, ["ab", "ab", "cd"], [7, 7, 7]), items_frame(spark, [(1, "ab")])).collect()
    assert [(r.rank, r.doc_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 7), (2, 7)] and got[0].score == got[1].score
    assert search.rank_documents(doc_frame(spark, ["ab"], [None]), items_frame(spark, [(1, "ab")])).count() == 0


def test_tiles_are_exact_and_bounded():
    """Weights beyond a tile's bound are dealt to several tiles; products equal those of plain integers."""
    r = random.Random(5)
    n_items, n_terms, n_docs = 4, 1500, 9
    postings = [(i, t, r.choice([1, 37, search.MOST_WEIGHT - 1, 5 * search.MOST_WEIGHT + 3])) for i in range(n_items) for t in r.sample(range(n_terms), 400)]
    tiles = search.tiles_of(postings, n_items)
    for terms, i, _, w in tiles:
        assert len(terms) <= search.TILE_TERMS and np.bincount(i, w).max() * search.MOST_IMPACT < 2**53
    cells = {(r.randrange(n_docs), r.randrange(n_terms)): r.randint(1, 999) for _ in range(3000)}
    row, at = (np.array(x) for x in zip(*cells))
    got = search.multiply(tiles, n_items, n_terms, row, at, np.array(list(cells.values())), n_docs)
    want = [[0] * n_docs for _ in range(n_items)]
    for i, t, w in postings:
        for d in range(n_docs):
            want[i][d] += w * cells.get((d, t), 0)
    assert got.tolist() == want


# ---------------------------------------------------------------- hard negatives


def vectors(spark, rows):
    return spark.createDataFrame([(i, lab, v, 1, "x") for i, lab, v in rows], "vec_id long, label long, v array<long>, size int, anchor string").repartition(3)


def test_negatives_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BATCH_ROWS", 64)
    monkeypatch.setattr(negatives, "BATCH_ANCHORS", 7)
    r = random.Random(6)
    for dims, spread, labels in ((40, 30, 3), (3, 2, 2), (70, 300, 40)):
        centres = [[r.randint(-spread, spread) for _ in range(dims)] for _ in range(5)]
        rows = [(i, r.randrange(labels) if r.random() < 0.6 else 0, [c + r.randint(-spread // 2, spread // 2) for c in r.choice(centres)]) for i in range(400)]
        rows += [rows[11], rows[12], rows[20], (401, 0, []), (402, 99, [1]), (-20, 0, [5] * dims), (410, 0, [0] * dims)]
        got = sorted(map(tuple, negatives.mine_hard_negatives(vectors(spark, rows), F.expr("vec_id % 10 = 0")).collect()))
        assert got == sorted(negatives.brute_force(rows, lambda i: i % 10 == 0)) and got
        small = negatives.mine_hard_negatives(vectors(spark, rows), F.expr("vec_id % 10 = 0"), block=dims * 9)
        assert sorted(map(tuple, small.collect())) == got


def test_negatives_large_numbers_and_edges(spark):
    big = 2**28
    rows = [(i, i % 2, [big + 3 * i, big - i, i]) for i in range(40)]
    got = sorted(map(tuple, negatives.mine_hard_negatives(vectors(spark, rows), F.expr("vec_id % 10 = 0"), low=90, high=101).collect()))
    assert got == sorted(negatives.brute_force(rows, lambda i: i % 10 == 0, low=90, high=101)) and got
    assert negatives.mine_hard_negatives(vectors(spark, []), F.expr("true")).count() == 0
    assert negatives.mine_hard_negatives(vectors(spark, [(1, 1, [1])]), F.expr("true")).count() == 0
    nan, inf = float("nan"), float("inf")
    odd = spark.createDataFrame([(1, 1, [0.5, -0.001]), (2, 1, [nan]), (3, 1, [inf]), (4, None, [1.0]), (5, 1, None), (6, 1, [None]), (None, 1, [1.0]), (7, 1, [])], "vec_id long, label int, embedding array<float>")
    assert sorted(map(tuple, negatives.clean_vectors(odd).collect())) == [(1, 1, [128, -1]), (7, 1, [])]


def test_index_omits_dimensions_and_loses_nothing():
    r = np.random.default_rng(7)
    x = (r.normal(size=(300, 64)) * np.geomspace(100, 1, 64)).astype(np.int64)
    rows = negatives.Rows(np.arange(300), np.zeros(300, np.int64), x)
    q = x[:20]
    for share in (0.9, 0.5, 0.0, -1.0):
        t = share * (q * q).sum(axis=1).astype(float)
        i, j, s = rows.join(q, t, None, np.arange(300))
        want = {(a, b, v) for (a, b), v in np.ndenumerate(q @ x.T) if v >= t[a]}
        assert set(zip(i.tolist(), j.tolist(), s.tolist())) == want


def test_full_lists_take_later_rows_below_the_first_level(spark, monkeypatch):
    """The first batch fills the lists with low scores; better ones of the next lie below the highest threshold."""
    monkeypatch.setattr(negatives, "BATCH_ROWS", 6)
    anchor, far = (0, 0, [100, 0]), [0, 1000]
    poor = [(1, 0, [10, 0]), (2, 0, [11, 0]), (3, 1, [20, 0]), (4, 1, [21, 0]), (5, 1, far)]
    better = [(6, 0, [30, 0]), (7, 0, [40, 0]), (8, 0, far), (9, 1, [22, 0]), (11, 1, [23, 0])]
    rows = [anchor, *poor, *better]
    one = vectors(spark, rows).coalesce(1).sortWithinPartitions("vec_id")
    got = sorted(map(tuple, negatives.mine_hard_negatives(one, F.expr("vec_id = 0"), 2, 2).collect()))
    assert got == sorted(negatives.brute_force(rows, lambda i: i == 0, 2, 2)) and got

    r = np.random.default_rng(11)
    x = np.abs(r.normal(size=(200, 8)) * 100).astype(np.int64)
    ids, labels = np.arange(200), np.arange(200) % 2
    positives, windows = negatives.Lists(5, 3), negatives.Lists(5, 2)
    low, high = np.full((5, 1), 10), (x[:5] @ x.T).max(axis=1, keepdims=True)
    for k in range(0, 200, 8):
        part = negatives.Rows(ids[k : k + 8], labels[k : k + 8], x[k : k + 8])
        negatives.add_positives(part, ids[:5], labels[:5], x[:5], positives)
        negatives.add_negatives(part, ids[:5], labels[:5], x[:5], low, high, windows)
    for found, same, k in ((positives, True, 3), (windows, False, 2)):
        for a in range(5):
            s = sorted((-int(x[a] @ x[i]), i) for i in range(200) if i != a and (labels[i] == labels[a]) == same)
            assert [(-int(n), int(i)) for n, i in zip(found.score[found.group == a], found.ident[found.group == a])] == s[:k]

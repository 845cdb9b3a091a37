"""Ranked lexical search: dense blocked BLAS multiplication.

Items (queries) are taken in blocks of bounded size. For a block, one pass over the documents writes a profile of each: its
length and its counts of the block's terms. Document frequencies are sums over the profiles. A second pass multiplies tiles:
an (items x terms) matrix of weights by a (terms x documents) matrix of impacts, in float64 by BLAS. Weights and impacts are
whole numbers and the vocabulary is cut into tiles so that no partial sum of any item reaches 2^53, so every product is
exact in whatever order BLAS adds; tiles are summed in int64. Each task keeps the k best documents of an item over all its
tiles, equal scores by smaller doc_id; the tasks' lists are then cut down by parts of a group and merged.

Memory of a task: BLOCK postings, one tile of weights at a time (items x TILE_TERMS), one tile of documents. The number of
passes over the documents grows with the items' size alone.

Defined results: a null or empty text has no terms, is no document and is never returned; an item without terms has no rows;
exact repeats of an item row count once, different texts of one item_id are one item with the terms of all; rows that share
a doc_id are documents of their own; rows without doc_id take no part; equal scores go by ascending doc_id; an empty table
on either side gives no rows; columns besides doc_id, text, item_id, whatever their names, are ignored; a very long text is
counted in slices.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import best_rows, bounded_blocks, keep_best, map_arrow, materialize, text_bytes, text_chunks
from .decontam import WORD_TABLE

#: Size of a block of items: its distinct (item, term) pairs and ITEM_WEIGHT for each item.
BLOCK = 200_000
ITEM_WEIGHT = 50
#: Terms of a vocabulary tile, at most.
TILE_TERMS = 512
#: Cells of a tile of scores (items x documents), at most.
TILE_SCORES = 4_000_000
#: Bytes of text that are split into terms at a time.
SLICE = 1 << 20
#: An impact is below this, since (10^9 * tf) div (1000 * tf + 12 * m) < 10^6.
MOST_IMPACT = 10**6
#: The weights of an item in one tile have this sum at most, so that its partial sums stay below 2^53.
MOST_WEIGHT = (2**53 - 1) // MOST_IMPACT


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, A-Z lower-cased, in slices that end between terms."""
    text, at = text.translate(WORD_TABLE), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def texts_of(col: pa.Array) -> Iterator[bytes]:
    buf, off = text_bytes(col)
    for a, b in zip(off[:-1], off[1:]):
        yield buf[a:b].tobytes()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, q) for every distinct term of an item."""
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()

    def run(batches):
        for part, col in text_chunks(batches, "text"):
            for i, text in enumerate(texts_of(col)):
                c: Counter = Counter()
                for words in terms(text):
                    c.update(words)
                ids = pa.chunked_array([part.column(0).slice(i, 1)] * len(c), part.column(0).type).combine_chunks() if c else None
                if c:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["item_id", "term", "q"])

    kind = items.schema["item_id"].dataType.simpleString()
    return map_arrow(rows, run, f"item_id {kind}, term binary, q long").groupBy("item_id", "term").agg(F.sum("q").alias("q"))


def profiles(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, at, tf): terms with repeats, and the counts of the terms of the (broadcast) vocabulary by their index."""

    def run(batches):
        index = {t: i for i, t in enumerate(vocabulary.value)}
        for part, col in text_chunks(batches, "text"):
            n, at, tf, off = [], [], [], [0]
            for text in texts_of(col):
                c, total = Counter(), 0
                for words in terms(text):
                    total += len(words)
                    c.update(map(index.get, words))
                c.pop(None, None)
                n.append(total)
                at += c.keys()
                tf += c.values()
                off.append(len(at))
            lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x, kind)) for x, kind in ((at, pa.int32()), (tf, pa.int64()))]
            out = pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "at", "tf"])
            yield out.filter(pa.array([x > 0 for x in n], pa.bool_()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows.where("doc_id is not null and text is not null"), run, "doc_id long, n long, at array<int>, tf array<long>")


def tiles_of(postings: list[tuple[int, int, int]], n_items: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tiles (terms, rows, columns, weights) of postings (item, term, weight); columns count within terms.

    A tile has TILE_TERMS terms and, for each item, MOST_WEIGHT of weight at most; a larger weight is dealt to several tiles."""
    by_term = defaultdict(list)
    for item, term, w in postings:
        if w > 0:
            by_term[term].append((item, w))
    out, held, room = [], [], np.full(n_items, MOST_WEIGHT)

    def close():
        nonlocal held, room
        if held:
            rows, cols, w = (np.array(x, np.int64) for x in zip(*((i, k, w) for k, (_, own) in enumerate(held) for i, w in own)))
            out.append((np.array([t for t, _ in held]), rows, cols, w.astype(np.float64)))
        held, room = [], np.full(n_items, MOST_WEIGHT)

    for term in sorted(by_term):
        rest = by_term[term]
        while rest:
            if len(held) == TILE_TERMS or any(min(w, MOST_WEIGHT) > room[i] for i, w in rest):
                close()
            part = [(i, min(w, MOST_WEIGHT)) for i, w in rest]
            for i, w in part:
                room[i] -= w
            held.append((term, part))
            rest = [(i, w - MOST_WEIGHT) for i, w in rest if w > MOST_WEIGHT]
    close()
    return out


def multiply(tiles, n_items: int, n_terms: int, row: np.ndarray, at: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores (items x documents) in int64 of documents that have impact at (row, term)."""
    scores = np.zeros((n_items, n_docs), np.int64)
    column = np.full(n_terms, -1, np.int64)
    for names, i, k, w in tiles:
        column[names] = np.arange(len(names))
        c = column[at]
        column[names] = -1
        here = c >= 0
        used = np.unique(c[here])
        if not len(used):
            continue
        compact = np.full(len(names), -1, np.int64)
        compact[used] = np.arange(len(used))
        weights = np.zeros((n_items, len(used)))
        own = compact[k] >= 0
        weights[i[own], compact[k[own]]] = w[own]
        impacts = np.zeros((len(used), n_docs))
        impacts[compact[c[here]], row[here]] = impact[here]
        scores += (weights @ impacts).astype(np.int64)
    return scores


def best_documents(written: DataFrame, held, n_docs: int, n_words: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of every item of a block among those of each task."""

    def run(batches):
        tiles, n_items, n_terms = held.value
        group, score, ident = (np.zeros(0, np.int64) for _ in range(3))
        step = max(64, min(2048, TILE_SCORES // n_items))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                lists = part.column(2)
                ids, n = (part.column(j).to_numpy(zero_copy_only=False) for j in (0, 1))
                row = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths()))
                at = np.asarray(lists.flatten()).astype(np.int64)
                tf = np.asarray(part.column(3).flatten()).astype(np.int64)
                m = 75 + (25 * n * n_docs) // n_words
                impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
                scores = multiply(tiles, n_items, n_terms, row, at, impact, len(ids))
                least = np.ones(n_items, np.int64)
                full = np.flatnonzero(np.bincount(group, minlength=n_items) == k)
                least[full] = score[np.searchsorted(group, full, "right") - 1]
                g, d = np.nonzero(scores >= np.maximum(least, 1)[:, None])
                group, score, ident = keep_best(*(np.concatenate(x) for x in ((group, g), (score, scores[g, d]), (ident, ids[d]))), k)
        yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(ident), pa.array(score)], ["item", "doc_id", "score"])

    return map_arrow(written, run, "item int, doc_id long, score long")


def weight_of(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search_block(docs: DataFrame, postings: list[tuple[object, bytes, int]], k: int, label: str) -> DataFrame | None:
    """The k best documents of each item of postings (item_id, term, q), or None where no document has a term."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, t, _ in postings})
    written = materialize(profiles(docs, spark.sparkContext.broadcast(vocabulary)), label)
    n_docs, n_words = written.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    found = dict(map(tuple, written.select(F.explode("at").alias("at")).groupBy("at").count().collect()))  # a row for each term of the block
    index, items = {t: i for i, t in enumerate(vocabulary)}, {}
    weighed = [(items.setdefault(i, len(items)), index[t], q * weight_of(found[index[t]], n_docs)) for i, t, q in postings if index[t] in found]
    if not weighed:
        return None
    tiles = tiles_of(weighed, len(items))
    held = spark.sparkContext.broadcast((tiles, len(items), len(vocabulary)))
    return best_documents(written, held, n_docs, n_words, k).join(F.broadcast(names_of(spark, items)), "item").drop("item")


def names_of(spark, items: dict) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in items.items()], "item int, item_id " + ("long" if all(i is None or isinstance(i, int) for i in items) else "string"))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of docs(doc_id, text) that score highest for each of items(item_id, text)."""
    spark = docs.sparkSession
    if items.schema["item_id"].dataType.simpleString() not in ("string", "bigint"):
        items = items.withColumn("item_id", F.col("item_id").cast("long"))
    pairs = materialize(item_terms(items), "item-terms")
    sizes = pairs.groupBy("item_id").agg((F.count("*") + ITEM_WEIGHT).alias("size"))
    numbered, ranges = bounded_blocks(sizes, "size", block, "item-sizes")
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"doc_id long, score long, item_id {kind}")
    for b, (lo, hi) in enumerate(ranges):
        own = pairs if len(ranges) == 1 else pairs.alias("p").join(numbered.where(F.col("no").between(lo, hi)).alias("s"), F.expr("p.item_id <=> s.item_id"), "left_semi")
        found = search_block(docs, [(r[0], bytes(r[1]), r[2]) for r in own.select("item_id", "term", "q").collect()], k, f"profiles-{b}")
        if found is not None:
            out = out.unionByName(found.select(*out.columns)) if b else found.select(*out.columns)
    return best_rows(out, ["item_id"], [F.desc("score"), F.asc("doc_id")], k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def brute_force(texts: list[tuple[int, str | None]], items: list[tuple[int, str | None]], k: int = 20) -> list[tuple[int, int, int, int]]:
    """(item_id, rank, doc_id, score) in plain integers; for tests."""
    count = lambda t: Counter(w for s in terms((t or "").encode()) for w in s)
    docs = [(i, c, sum(c.values())) for i, c in ((i, count(t)) for i, t in texts) if c]
    n_docs, n_words = len(docs), sum(n for _, _, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    asked: dict = defaultdict(Counter)
    for i, t in dict.fromkeys(items):
        asked[i] += count(t)
    out = []
    for i, q in asked.items():
        scored = []
        for d, c, n in docs:
            m = 75 + (25 * n * n_docs) // n_words
            s = sum(f * weight_of(df[w], n_docs) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w, f in q.items() if c[w])
            if s > 0:
                scored.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return out

"""Hard-negative mining: threshold joins in the manner of L2AP, over blocks of anchors.

Rows stay where they are. Anchors come in blocks of bounded size, each broadcast for two passes over all rows: one finds
every anchor's positives (the first n_positive other rows of its label), the next the negatives, which are rows of other
labels whose score lies in a window below a positive's score.

A pass is a threshold join of a batch of rows with the anchors. Dimensions are ordered by their mass in the batch and cut
into tiles. A row is indexed in the tiles up to the point from which its suffix norm, times the largest suffix norm of the
anchors, stays below the least threshold: the rest of its dimensions can't lift a pair to the threshold and has no postings.
Scores are accumulated tile by tile over the postings; a pair is pruned when its partial score and the product of the
remaining norms stay below its anchor's threshold, and a row leaves the later tiles when all its pairs are pruned. Pairs
that are left get their remaining dimensions and their exact score.

Thresholds begin high and are lowered until the anchor's list or windows are full, or the window's lower end is reached.
What the task has found so far bounds them from below: once a window is full, nothing under its last score matters. So each
task returns its own first rows of each list, which hold the first rows over all tasks; these are cut down by parts of a
group and merged.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part; components become
floor(scale * x), saturating at 64 bits; vectors of unequal length count as if filled up with zeros; scores are exact in 64-bit integers (and
wrap beyond them); equal scores go by smaller id; rows that share their id with the anchor are neither its positives nor its
negatives; repeated rows are rows of their own; an anchor without positives, or a positive without negatives, has no rows; an empty table gives none; columns
besides the three named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import best_rows, bounded_blocks, keep_best, map_arrow, materialize

#: Components of the anchors of one block (8 bytes each).
BLOCK = 4_000_000
#: Rows and anchors that meet at a time in a task, and dimensions of a tile.
BATCH_ROWS, BATCH_ANCHORS, TILE = 4096, 1024, 16
#: First thresholds: shares of the largest possible score for positives, of the way down the window for negatives.
POSITIVE_LEVELS, NEGATIVE_LEVELS = (0.8, 0.6, 0.4, 0.2), (0.25, 0.5, 0.75)
#: Floats hold whole numbers below this; beyond, scores are taken again in integers.
EXACT = 2.0**52


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of an int64 matrix, filled up with zeros."""
    n = np.asarray(lists.value_lengths()).astype(np.int64)
    out = np.zeros((len(n), max(width, int(n.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = np.asarray(lists.flatten())
    return out


def suffix_norms(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Norms of x[:, cut:] for each cut."""
    squares = np.concatenate([np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1)
    return np.sqrt(squares[:, cuts])


class Rows:
    """A batch of rows: dimensions in the order of their mass, suffix norms at the ends of tiles."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.whole = ids, labels, vectors
        x = vectors.astype(np.float64)
        self.order = np.argsort(-(x * x).sum(axis=0), kind="stable")
        self.x = np.ascontiguousarray(x[:, self.order])
        self.cuts = np.append(np.arange(0, x.shape[1], TILE), x.shape[1])
        self.norms = suffix_norms(self.x, self.cuts)

    def join(self, anchors: np.ndarray, thresholds: np.ndarray, allowed: np.ndarray | None, own: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor, row, score) of the pairs of anchors with the rows own that reach the anchor's threshold.

        anchors: whole vectors. allowed: pairs (anchors x own) that may be returned, all if None."""
        q = anchors[:, self.order].astype(np.float64)
        qn, vn, x = suffix_norms(q, self.cuts), self.norms[own], self.x[own]
        top = qn.max(axis=0, initial=0.0)
        slack = 0.5 + 1e-9 * top[0] * vn[:, 0].max(initial=0.0)
        t = thresholds - slack
        # tiles in which a row has postings: up to the first cut from which the rest can't reach any threshold
        depth = (vn * top >= t.min(initial=np.inf)).sum(axis=1)
        depth = np.minimum(depth, len(self.cuts) - 1)
        score = np.zeros((len(q), len(own)))
        alive = np.ones((len(q), len(own)), bool) if allowed is None else allowed.copy()
        live = (depth > 0) if np.isfinite(t).any() else np.ones(len(own), bool)
        alive[:, ~live] = False
        for j in range(len(self.cuts) - 1):
            at = np.flatnonzero(live & (depth > j))
            if not len(at):
                break
            a, b = self.cuts[j], self.cuts[j + 1]
            score[:, at] += q[:, a:b] @ x[at, a:b].T
            alive[:, at] &= score[:, at] + np.outer(qn[:, j + 1], vn[at, j + 1]) >= t[:, None]
            live[at] = alive[:, at].any(axis=0)
        i, r = np.nonzero(alive)
        exact = top[0] * vn[:, 0].max(initial=0.0) < EXACT
        s = np.empty(len(i), np.int64)
        for k in range(0, len(i), 1 << 16):  # what has no postings is added for the pairs that are left
            ii, rr = i[k : k + (1 << 16)], r[k : k + (1 << 16)]
            if exact:
                s[k : k + len(ii)] = score[ii, rr] + self.rest(q, x, depth, ii, rr)
            else:
                s[k : k + len(ii)] = (anchors[ii] * self.whole[own[rr]]).sum(axis=1)
        keep = s >= thresholds[i]
        return i[keep], r[keep], s[keep]

    def rest(self, q: np.ndarray, x: np.ndarray, depth: np.ndarray, i: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        for d in np.unique(depth[r]):
            if d < len(self.cuts) - 1:
                at = np.flatnonzero(depth[r] == d)
                out[at] = (q[i[at], self.cuts[d] :] * x[r[at], self.cuts[d] :]).sum(axis=1)
        return out


class Lists:
    """The first k entries of each of n lists, by falling score and rising id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.group, self.score, self.ident = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        self.group, self.score, self.ident = keep_best(
            np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.ident, ident]), self.k
        )

    def last(self) -> np.ndarray:
        """The last score of each full list, -inf of the others."""
        out = np.full(self.n, -np.inf)
        full = np.flatnonzero(np.bincount(self.group, minlength=self.n) == self.k)
        out[full] = self.score[np.searchsorted(self.group, full, "right") - 1]
        return out


class Chunks:
    """Lists of all anchors of a block, n for each, held by chunks of BATCH_ANCHORS, so that an addition sorts those of its chunk alone."""

    def __init__(self, anchors: int, n: int, k: int):
        self.size, self.n = BATCH_ANCHORS, n
        self.parts = [(slice(a, a + self.size), Lists(min(self.size, anchors - a) * n, k)) for a in range(0, anchors, self.size)]

    def batches(self, name: str) -> Iterator[pa.RecordBatch]:
        for at, x in self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(at.start * self.n + x.group), pa.array(x.ident), pa.array(x.score)], [name, "vec_id", "score"])


def add_positives(rows: Rows, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lists: Lists) -> None:
    """Puts the rows of the anchors' labels into their lists."""
    by_label = np.argsort(rows.labels, kind="stable")
    for label in np.intersect1d(labels, rows.labels):
        own = by_label[slice(*np.searchsorted(rows.labels[by_label], [label, label + 1]))]
        todo, most = np.flatnonzero(labels == label), rows.norms[own, 0].max()
        for level in (*POSITIVE_LEVELS, -np.inf):
            last = lists.last()[todo]
            norm = np.sqrt((vectors[todo].astype(np.float64) ** 2).sum(axis=1))
            known = np.isfinite(last)  # a full list takes all that its last score lets in, whatever the level
            t = np.where(known, last, level * (norm * most + 1))
            i, r, s = rows.join(vectors[todo], t, None, own)
            # a list that is not full is joined again at a lower threshold, unless what it got fills it
            got = np.bincount(i[rows.ids[own[r]] != ids[todo[i]]], minlength=len(todo))
            settled = known | (got >= lists.k) | (level == -np.inf)
            take = settled[i] & (rows.ids[own[r]] != ids[todo[i]])
            lists.add(todo[i[take]], s[take], rows.ids[own[r[take]]])
            todo = todo[~settled]
            if not len(todo):
                break


def add_negatives(rows: Rows, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lo: np.ndarray, hi: np.ndarray, lists: Lists) -> None:
    """Puts rows of other labels into the windows [lo, hi] (anchors x windows, empty where hi < lo), list i * windows + w."""
    n = lo.shape[1]
    todo = np.flatnonzero((hi >= lo).any(axis=1))
    for level in (*NEGATIVE_LEVELS, 1.0):
        if not len(todo):
            return
        low, high = lo[todo], hi[todo]
        last = lists.last().reshape(-1, n)[todo]
        level_t = np.where(np.isfinite(last) | (level == 1), low, high - np.floor(level * (high - low)))
        t = np.where(high >= low, np.maximum(last, np.maximum(level_t, low)), np.inf)
        least = t.min(axis=1)
        apart = (labels[todo][:, None] != rows.labels[None, :]) & (ids[todo][:, None] != rows.ids[None, :])
        i, r, s = rows.join(vectors[todo], least, apart, np.arange(len(rows.ids)))
        inside = (s[:, None] >= np.maximum(low, least[:, None])[i]) & (s[:, None] <= high[i])
        got = np.zeros(low.shape, np.int64)
        for w in range(n):
            got[:, w] = np.bincount(i[inside[:, w]], minlength=len(todo))
        full = (high < low) | (low >= least[:, None]) | np.isfinite(last) | (got >= lists.k)
        settled = full.all(axis=1)
        take, w = np.nonzero(inside & settled[i][:, None])
        lists.add(todo[i[take]] * n + w, s[take], rows.ids[r[take]])
        todo = todo[~settled]


def batches_of(batches, width: int):
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(k, BATCH_ROWS)
            yield Rows(part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2), width))


def first_positives(rows: DataFrame, held, k: int) -> DataFrame:
    """(anchor, vec_id, score): each task's first k rows of the anchor's label."""

    def run(batches):
        ids, labels, vectors = held.value
        lists = Chunks(len(ids), 1, k)
        for part in batches_of(batches, vectors.shape[1]):
            own = widened(vectors, part)
            for to, x in lists.parts:
                add_positives(part, ids[to], labels[to], own[to], x)
        yield from lists.batches("anchor")

    return map_arrow(rows, run, "anchor long, vec_id long, score long")


def first_negatives(rows: DataFrame, held, windows, k: int) -> DataFrame:
    """(list, vec_id, score): each task's first k rows of the windows; list counts the windows of all anchors."""

    def run(batches):
        (ids, labels, vectors), (lo, hi) = held.value, windows.value
        lists = Chunks(len(ids), lo.shape[1], k)
        for part in batches_of(batches, vectors.shape[1]):
            own = widened(vectors, part)
            for to, x in lists.parts:
                add_negatives(part, ids[to], labels[to], own[to], lo[to], hi[to], x)
        yield from lists.batches("list")

    return map_arrow(rows, run, "list long, vec_id long, score long")


def widened(vectors: np.ndarray, rows: Rows) -> np.ndarray:
    more = rows.whole.shape[1] - vectors.shape[1]
    return np.pad(vectors, ((0, 0), (0, more))) if more > 0 else vectors


def clean_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id long, label long, v array<long>) of the rows that take part; components are floor(scale * x), x as double."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    x = F.col("embedding").cast("array<double>")
    return (
        rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
        .where("vec_id is not null and label is not null and x is not null").where(F.forall("x", finite))
        .select("vec_id", "label", F.transform("x", lambda y: F.floor(y * scale).cast("long")).alias("v"))
    )


def mine_hard_negatives(
    rows: DataFrame, is_anchor, n_positive: int = 5, n_negative: int = 3, low: int = 50, high: int = 95, block: int = BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows(vec_id, label, v).

    is_anchor: condition that marks the anchors. A negative's score lies between low and high per cent of the positive's."""
    spark = rows.sparkSession
    sized = rows.where(is_anchor).select("vec_id", "label", "v", F.greatest(F.size("v"), F.lit(1)).cast("long").alias("size"))
    anchors, ranges = bounded_blocks(sized, "size", block, "anchors")
    out = None
    for b, (a, z) in enumerate(ranges):
        found = mine_block(rows, anchors.where(F.col("no").between(a, z)), n_positive, n_negative, low, high, f"{b}")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def mine_block(rows: DataFrame, anchors: DataFrame, n_positive: int, n_negative: int, low: int, high: int, label: str) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    own = anchors.select("vec_id", "label", "v").orderBy("no").toArrow().combine_chunks()  # bounded by the block
    ids, labels = (own.column(k).to_numpy() for k in (0, 1))
    held = sc.broadcast((ids, labels, matrix(own.column(2).combine_chunks(), 0)))
    found = best_rows(first_positives(rows, held, n_positive), ["anchor"], [F.desc("score"), F.asc("vec_id")], n_positive)
    positives = materialize(found, f"positives-{label}")
    lo = np.zeros((len(ids), n_positive), np.int64)
    hi = lo - 1
    for anchor, rank, score in positives.select("anchor", "rank", "score").collect():  # n_positive rows an anchor of the block
        lo[anchor, rank - 1], hi[anchor, rank - 1] = -(-low * score // 100), high * score // 100
    lists = best_rows(first_negatives(rows, held, sc.broadcast((lo, hi)), n_negative), ["list"], [F.desc("score"), F.asc("vec_id")], n_negative)
    names = rows.sparkSession.createDataFrame(pa.table({"anchor": np.arange(len(ids)), "anchor_id": ids}))
    pairs = positives.join(F.broadcast(names), "anchor").select(
        (F.col("anchor") * n_positive + F.col("rank") - 1).alias("list"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return pairs.join(lists, "list").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def brute_force(rows: list[tuple[int, int, list[int]]], is_anchor, n_positive=5, n_negative=3, low=50, high=95) -> list[tuple]:
    """The same in plain integers; for tests."""
    out = []
    for a, label, v in rows:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in rows if i != a)
        for p, pid in [(-s, i) for s, i, m in scored if m == label][:n_positive]:
            fit = [(-s, i) for s, i, m in scored if m != label and low * p <= -100 * s <= high * p][:n_negative]
            out += [(a, pid, r, i, p, s) for r, (s, i) in enumerate(fit, 1)]
    return out

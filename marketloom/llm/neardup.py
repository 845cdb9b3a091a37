"""Near-duplicate groups by min-max hashing.

Each permutation of the shingle hashes keeps its minimum and its maximum, so 32 hash evaluations give 64 signature
values; bands of four values make candidate buckets (16 bands: a pair at similarity 0.85 shares one with probability
1 - 7e-6). Texts with equal shingle sets are one class and take part once. Candidates are confirmed on full shingle
sets in two rounds:

1. every class of a bucket with the bucket's hub, the class that shares most buckets with others. In a group of near
   copies the text that was copied is the hub and links all of them, so the work is linear in the group;
2. classes that their hub did not link, with the other classes of the bucket: as pairs in buckets of up to LIGHT
   classes, as pairs of blocks of bounded size in larger ones. Pairs that round 1 already joined are left out.

No partner is dropped and no cap applies. Keys that hold more than a fixed share of all rows are joined by broadcast
(there are HOT_KEYS of them at most), and texts that are in no bucket are kept out of the shuffle by a Bloom filter.

Defined results: a null text, or one without words, has no shingle, is its own component and is kept; with fewer words
than a shingle the whole sequence is the one shingle; repeated rows fall in one class; ties go to the smallest doc_id;
a null doc_id gets component null and kept true; rows that share a doc_id with different texts are one node; a very
long text is hashed whole, as a step of its own; an empty table gives no rows; other columns, whatever their names,
are ignored or passed on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, connected_components, gram_hashes, join_hot, map_arrow, materialize, maybe_in, mix, split_in, text_chunks

WORDS, PERMUTATIONS, ROWS = 5, 32, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Classes in a bucket whose open pairs are listed; larger buckets are compared in blocks.
LIGHT = 64
#: Shingles of a hub's members that are compared in one group, and in a block of the second round.
STAR_SHINGLES, BLOCK_SHINGLES = 16_000, 400_000

_rng = np.random.Generator(np.random.PCG64(77))
_mul = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_add = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.int64).astype(np.uint64)


def shingles(col: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): shingle hashes of each text, in text order with repeats; first[d]:first[d + 1] is text d."""
    w = Words(col, lower=True)
    counts = w.counts()
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(first[-1], np.uint64)
    h = gram_hashes(w.hashes, n)
    long = np.repeat(counts >= n, per)
    at = np.arange(first[-1]) - np.repeat(first[:-1], per) + np.repeat(w.first[:-1], per)
    out[long] = h[at[long]]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        k = int(counts[d])
        out[first[d]] = gram_hashes(w.hashes[w.first[d] : w.first[d + 1]], k)[0] + np.uint64(k)
    return out, first


def distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with each text's hashes sorted and without repeats."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(o[keep], minlength=len(first) - 1))]).astype(np.int64)


def min_max(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signatures (rows x 2 * PERMUTATIONS) of non-empty sets: minimum and maximum under each permutation."""
    sig = np.empty((len(first) - 1, 2 * PERMUTATIONS), np.uint32)
    for k in range(PERMUTATIONS if len(sig) else 0):
        v = ((hashes * _mul[k] + _add[k]) >> np.uint64(32)).astype(np.uint32)
        sig[:, 2 * k] = np.minimum.reduceat(v, first[:-1])
        sig[:, 2 * k + 1] = np.maximum.reduceat(v, first[:-1])
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Keys (rows x BANDS) of the signatures; a band takes minima and maxima of ROWS / 2 permutations."""
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), b + 1, np.uint64)
        for v in sig[:, b * ROWS : (b + 1) * ROWS].T:
            h = mix(h) + v
        out[:, b] = mix(h)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the shingle set), bands (array of BANDS keys; empty without shingles)."""
    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>"

    def run(batches):
        for part, col in text_chunks(batches, "text"):
            h, first = distinct(*shingles(col))
            n = np.diff(first)
            keys = band_keys(min_max(h, first[np.append(n > 0, True)]))
            ends = np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32)
            sets = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n), pa.array(sets, pa.binary()), pa.ListArray.from_arrays(ends, keys.ravel().view(np.int64))],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )

    return map_arrow(docs, run, schema)


# ---------------------------------------------------------------- comparison on full sets


class Sets:
    """Rows (gid, side, rep, label) with their shingle sets; side 0 is compared with side 1 of the same gid."""

    def __init__(self, cols: list[np.ndarray], flat: np.ndarray, first: np.ndarray):
        self.gid, self.side, self.rep, self.label = cols
        self.flat, self.first, self.n = flat, first, np.diff(first)

    def take(self, a: int, b: int) -> Sets:
        cols = [c[a:b] for c in (self.gid, self.side, self.rep, self.label)]
        return Sets(cols, self.flat[self.first[a] : self.first[b]], self.first[a : b + 1] - self.first[a])

    def __add__(self, other: Sets) -> Sets:
        cols = [np.concatenate(x) for x in zip((self.gid, self.side, self.rep, self.label), (other.gid, other.side, other.rep, other.label), strict=True)]
        return Sets(cols, np.concatenate([self.flat, other.flat]), np.concatenate([self.first, other.first[1:] + self.first[-1]]))


def star_links(s: Sets, percent: int) -> np.ndarray:
    """Links (rows of two reps) of groups with one row on side 0, all groups at once."""
    row = np.repeat(np.arange(len(s.n)), s.n)
    keys = mix(s.flat ^ mix(s.gid.view(np.uint64))[row])
    left = s.side == 0
    hub = np.maximum.accumulate(np.where(left, np.arange(len(s.n)), 0))  # rows are sorted by gid, side
    mine = np.sort(keys[left[row]])
    at = np.searchsorted(mine, keys)
    same = mine[np.minimum(at, len(mine) - 1)] == keys if len(mine) else np.zeros(len(keys), bool)
    both = np.bincount(row[same], minlength=len(s.n))
    near = ~left & (s.gid == s.gid[hub]) & (both > 0) & (100 * both >= percent * (s.n + s.n[hub] - both)) & (s.rep != s.rep[hub])
    return np.stack([s.rep[hub][near], s.rep[near]], 1)


def block_links(s: Sets, percent: int) -> np.ndarray:
    """Links of one group of any shape; only those that join rows of different labels."""
    left, right = np.flatnonzero(s.side == 0), np.flatnonzero(s.side == 1)
    _, group = np.unique(s.label, return_inverse=True)
    parent = np.arange(len(s.n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    owner = np.repeat(np.arange(len(s.n)), s.n)
    of_right = s.side[owner] == 1
    order = np.argsort(s.flat[of_right], kind="stable")
    owner, value = owner[of_right][order], s.flat[of_right][order]
    out = []
    for x in left.tolist():
        mine = s.flat[s.first[x] : s.first[x + 1]]
        lo, hi = np.searchsorted(value, mine, "left"), np.searchsorted(value, mine, "right")
        size = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        both = np.bincount(owner[at], minlength=len(s.n))
        near = (100 * both >= percent * (s.n + s.n[x] - both)) & (both > 0) & (group != group[x]) & (s.rep != s.rep[x])
        for y in np.flatnonzero(near[right]):
            p, q = find(int(group[x])), find(int(group[right[y]]))
            if p != q:
                parent[p] = q
                out.append((s.rep[x], s.rep[right[y]]))
    return np.array(out, np.int64).reshape(-1, 2)


def links_of(s: Sets, percent: int) -> np.ndarray:
    """Links of complete groups, sorted by gid and side."""
    if not len(s.gid):
        return np.zeros((0, 2), np.int64)
    start = np.flatnonzero(np.append(True, s.gid[1:] != s.gid[:-1]))
    lefts = np.add.reduceat((s.side == 0).astype(np.int64), start)
    if (lefts <= 1).all():
        return star_links(s, percent)
    ends = np.append(start[1:], len(s.gid))
    return np.concatenate([(star_links if k <= 1 else block_links)(s.take(a, b), percent) for a, b, k in zip(start, ends, lefts, strict=True)])


def compare(dealt: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the two sides of each group of dealt(gid, side, rep, label); texts(rep, text).

    A task holds one group, or several of about BLOCK_SHINGLES together."""
    rows = dealt.hint("merge").join(texts, "rep").select("gid", "side", "rep", "label", "text")
    rows = rows.repartition("gid").sortWithinPartitions("gid", "side")

    def run(batches):
        held = None
        for part, col in text_chunks(batches, "text"):
            cols = [part.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            new = Sets(cols, *distinct(*shingles(col)))
            held = held + new if held else new
            last = int(np.searchsorted(held.gid, held.gid[-1]))
            if last and len(held.flat) > BLOCK_SHINGLES:
                yield batch_of(links_of(held.take(0, last), percent))
                held = held.take(last, len(held.gid))
        if held:
            yield batch_of(links_of(held, percent))

    return map_arrow(rows, run, "a long, b long")


def batch_of(links: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(links.min(1, initial=2**62)), pa.array(links.max(1, initial=-(2**62)))], ["a", "b"])


# ---------------------------------------------------------------- job


def blocks(shingles_in_all: Column, size: int) -> Column:
    """Blocks of about size shingles, a power of two."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), shingles_in_all / size)))).cast("long")


def fits(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m shingles can reach the threshold."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def buckets(classes: DataFrame) -> DataFrame:
    """(key, rep, n, m, size, hub, hub_n): the members of each bucket of two classes or more; m classes and size
    shingles in it, and its hub."""
    keys = classes.select("rep", "n", F.explode("bands").alias("key"))
    total = BANDS * classes.count()
    counts = materialize(keys.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("size")).where("m > 1"), "bands")
    members = materialize(join_hot(maybe_in(keys, "key", counts), counts, "key", "m", total), "members")
    degree = members.groupBy("rep").agg(F.sum(F.col("m") - 1).alias("degree"))
    ranked = members.hint("merge").join(degree, "rep")
    hub = F.max(F.struct("degree", (-F.col("rep")).alias("rep"), F.col("n").alias("n")))
    hubs = ranked.groupBy("key").agg(F.first("m").alias("weight"), hub.alias("h")).select("key", "weight", (-F.col("h.rep")).alias("hub"), F.col("h.n").alias("hub_n"))
    return materialize(join_hot(members, materialize(hubs, "hubs"), "key", "weight", total).drop("weight"), "buckets")


def star_round(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links of every member with its bucket's hub; a hub's members are dealt to groups of bounded size."""
    pairs = members.where((F.col("rep") != F.col("hub")) & fits(F.col("n"), F.col("hub_n"), percent))
    pairs = pairs.groupBy("hub", "rep").agg(blocks(F.max("size"), STAR_SHINGLES).alias("blocks"))
    pairs = pairs.withColumn("gid", F.xxhash64("hub", "blocks", F.pmod(F.xxhash64("rep"), "blocks")))
    left = pairs.select("gid", F.lit(0).alias("side"), F.col("hub").alias("rep"), F.col("hub").alias("label")).distinct()
    return compare(left.unionByName(pairs.select("gid", F.lit(1).alias("side"), "rep", F.col("rep").alias("label"))), texts, percent)


def rest_round(members: DataFrame, found: DataFrame, texts: DataFrame, percent: int, total: int) -> DataFrame:
    """Links of members that their hub did not link with the other members of their bucket."""
    near = found.select(F.explode(F.array(F.struct(F.col("a").alias("hub"), F.col("b").alias("rep")), F.struct(F.col("b").alias("hub"), F.col("a").alias("rep")))).alias("x"))
    near = near.select("x.hub", "x.rep", F.lit(True).alias("linked")).distinct()
    rows = members.where("rep <> hub and m > 2").hint("merge").join(near, ["hub", "rep"], "left")
    rows = materialize(rows.select("key", "rep", "n", "m", "size", F.coalesce("linked", F.lit(False)).alias("linked"), F.when(F.col("linked"), F.col("hub")).otherwise(F.col("rep")).alias("label")), "rest")
    open_size = F.sum(F.when(~F.col("linked"), F.col("n")))
    open_keys = rows.groupBy("key").agg(F.first("m").alias("weight"), open_size.alias("open")).where("open > 0")
    rows = materialize(join_hot(rows, materialize(open_keys, "open"), "key", "weight", total), "open-rows")

    light = rows.where(f"m <= {LIGHT}")
    x = light.where("not linked").select("key", F.col("rep").alias("x"), F.col("n").alias("x_n"))
    y = light.select("key", F.col("rep").alias("y"), F.col("n").alias("y_n"), F.col("linked").alias("y_linked"))
    pairs = x.hint("merge").join(y, "key").where(fits(F.col("x_n"), F.col("y_n"), percent) & ((F.col("x") < F.col("y")) | (F.col("y_linked") & (F.col("x") != F.col("y")))))
    pairs = pairs.select("x", "y").distinct()
    own = F.xxhash64("x")
    left = pairs.select(own.alias("gid"), F.lit(0).alias("side"), F.col("x").alias("rep"), F.col("x").alias("label")).distinct()
    right = pairs.select(own.alias("gid"), F.lit(1).alias("side"), F.col("y").alias("rep"), F.col("y").alias("label"))

    heavy = rows.where(f"m > {LIGHT}").withColumns({"i": blocks(F.col("open"), BLOCK_SHINGLES), "j": blocks(F.col("size"), BLOCK_SHINGLES)})
    mine = lambda of: F.pmod(F.xxhash64("rep", "key"), of)
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of).cast("int") - 1))
    low = heavy.where("not linked").select("key", "rep", "label", mine(F.col("i")).alias("p"), every("j").alias("q"))
    high = heavy.select("key", "rep", "label", every("i").alias("p"), mine(F.col("j")).alias("q"))
    deal = lambda df, side: df.select(F.xxhash64("key", "p", "q").alias("gid"), F.lit(side).alias("side"), "rep", "label")
    return compare(left.unionByName(right).unionByName(deal(low, 0)).unionByName(deal(high, 1)), texts, percent)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document of docs(doc_id, text): doc_id, n_shingles, component_id, kept."""
    one = docs.select(F.col("doc_id").cast("long"), "text")
    sig = materialize(signatures(one), "minmax")
    full = sig.where("set_key is not null and doc_id is not null")
    classes = full.groupBy("set_key").agg(F.min_by(F.struct("doc_id", "n_shingles", "bands"), "doc_id").alias("r"), F.count("*").alias("copies"))
    classes = materialize(classes.select("set_key", "copies", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"), F.col("r.bands").alias("bands")), "classes")
    members = buckets(classes)
    reps = materialize(members.groupBy("rep").agg(F.count("*").alias("bands")), "candidates")
    texts = maybe_in(one.where("text is not null").withColumnRenamed("doc_id", "rep"), "rep", reps)
    stars = materialize(star_round(members, texts, percent), "stars")
    links = stars.unionByName(rest_round(members, stars, texts, percent, BANDS * classes.count()))
    comps = connected_components(links, "near")
    named = classes.select("set_key", "copies", "rep").hint("merge").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    named = materialize(named.select("set_key", "copies", F.coalesce("component", "rep").alias("component")), "named")
    rows = join_hot(full.select("doc_id", "n_shingles", "set_key"), named, "set_key", "copies", sig.count()).select("doc_id", "n_shingles", "component")
    alone = sig.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True))
    return rows.unionByName(alone).select("doc_id", "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def filter_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each group stays: the rows whose doc_id is the smallest of their component."""
    gone = materialize(near_duplicates(docs, percent).where("not kept").groupBy("doc_id").agg(F.count("*").alias("rows")), "near-gone")
    some, other = split_in(docs, "doc_id", gone)
    kept = some.join(gone.select("doc_id").hint("merge"), "doc_id", "left_anti")
    return other.unionByName(kept.select(*(f"`{c}`" for c in docs.columns)))

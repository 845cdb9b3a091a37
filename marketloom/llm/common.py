"""Shared pieces of the training-data operators: scratch tables, Arrow batching, word hashing, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..sources.tables import scratch

#: Text bytes that one numpy step works on; a longer single text is a step of its own.
CHUNK_BYTES = 2 << 20

#: Removes shuffle files when a statement ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: ASCII white space \x20 \x09-\x0D, which ends a word.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


# ---------------------------------------------------------------- scratch tables


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and rereads it, which cuts lineage and survives lost executors.

    Spark removes the step's shuffle files at its end, since only the table is read later."""
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- Arrow batches


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as strings without nulls (null: empty), at offset 0."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.type != pa.string():
        col = col.cast(pa.string())
    return col.fill_null("") if col.null_count else col


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its int64 offsets, from 0."""
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def text_chunks(batches: Iterator[pa.RecordBatch], name: str, limit: int = CHUNK_BYTES):
    """Yields (slice of a batch, its texts) so that the texts of a slice have limit bytes at most, or are one text."""
    for batch in batches:
        col = text_column(batch, name)
        _, off = text_bytes(col)
        i, n = 0, len(col)
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), col.slice(i, j - i)
            i = j


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


# ---------------------------------------------------------------- word hashing

_rng = np.random.Generator(np.random.PCG64(20240917))
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
GRAM_BASE = np.uint64(0xD6E8FEB86659FD93)
_blank = np.zeros(256, bool)
_blank[list(BLANKS)] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, BASE_INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that near inputs give unrelated outputs."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = CHUNK_BYTES) -> np.ndarray:
    """A 64-bit hash of each ascending, non-overlapping byte span, in steps of bounded memory."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + step, "right")))
        b = int(ends[j - 1])
        pw, inv = powers(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(BYTE_VALUES[buf[a:b]] * pw[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64))
        i = j
    return out


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a chunk of texts: byte spans, hashes, and first[d]:first[d + 1] for text d.

    table: 256 bytes that the texts' bytes are translated by first.
    """

    def __init__(self, col: pa.Array, lower: bool = False, table: np.ndarray | None = None):
        raw, self.offsets = text_bytes(col)
        self.buf = table[raw] if table is not None else _lower[raw] if lower else raw
        n = len(self.buf)
        word = ~_blank[self.buf]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n, bool)
        before[:1] = True
        before[1:] = ~word[:-1]
        self.starts = np.flatnonzero(word & (before | edge[:n]))
        after = np.empty(n, bool)
        after[-1:] = True
        after[:-1] = ~word[1:]
        self.ends = np.flatnonzero(word & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = span_hashes(self.buf, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts())

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word index where it starts, hash) of each n-word window that lies in one text."""
        h = gram_hashes(self.hashes, n)
        if not len(h):
            return np.zeros(0, np.int64), h
        last = np.repeat(self.first[1:], self.counts())[: len(h)]
        at = np.flatnonzero(np.arange(len(h)) + n <= last)
        return at, h[at]


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling combination of n consecutive word hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * GRAM_BASE + h[k : k + m]
    return mix(out)


# ---------------------------------------------------------------- joins on hot keys and large sides

#: Keys that hold more than 1 / HOT_KEYS of all rows are fewer than this, whatever the data.
HOT_KEYS = 10_000
#: Bloom filters have this many words of 64 bits at most; with more keys they let more rows pass, never fewer.
BLOOM_WORDS = 1 << 20


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with keyed, which has each key once and in weight its number of rows; total: rows in all.

    Keys with more than max(1000, total / HOT_KEYS) rows are fewer than HOT_KEYS and are broadcast, so that their rows
    stay where they are; all others are joined by a shuffle in which no key is hot. Both inputs are read twice.
    how: inner or left."""
    limit = max(1000, total // HOT_KEYS)
    hot, cold = keyed.where(F.col(weight) > limit), keyed.where(F.col(weight) <= limit)
    here = rows.join(F.broadcast(hot), key)
    there = rows.join(F.broadcast(hot.select(key)), key, "left_anti").hint("merge").join(cold, key, how)
    return here.unionByName(there)


def split_in(rows: DataFrame, key: str, keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in keyed, rows whose key is not), by a Bloom filter over keyed (a written table).

    The filter is a table of BLOOM_WORDS rows at most, so its broadcast has a bound at every size. A null key is in the
    second part."""
    words, n = 1 << 10, keyed.count()
    while words < BLOOM_WORDS and words * 4 < n:
        words *= 2
    kind = keyed.schema[key].dataType.simpleString()
    at = lambda c: F.expr(f"pmod(xxhash64(cast(`{c}` as {kind}), 1), {words})")
    bit = lambda c, k: F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64(cast(`{c}` as {kind}), 2), {6 * k}), 64) as int))")
    mask = lambda c: bit(c, 0).bitwiseOR(bit(c, 1)).bitwiseOR(bit(c, 2))
    bloom = keyed.select(at(key).alias("_loom_at"), mask(key).alias("m")).groupBy("_loom_at").agg(F.bit_or("m").alias("_loom_bits"))
    both = rows.withColumn("_loom_at", F.when(F.col(key).isNotNull(), at(key))).join(F.broadcast(bloom), "_loom_at", "left")
    maybe = F.coalesce(F.col("_loom_bits").bitwiseAND(mask(key)) == mask(key), F.lit(False))
    names = [f"`{c}`" for c in rows.columns]
    return both.where(maybe).select(*names), both.where(~maybe).select(*names)


def maybe_in(rows: DataFrame, key: str, keyed: DataFrame) -> DataFrame:
    """The rows whose key is in keyed (a written table), and some others."""
    return split_in(rows, key, keyed)[0]


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node that can be reached.

    Alternating large-star and small-star steps: each is a partial minimum by node and a join back, so a hub is
    combined before the shuffle and split by the adaptive join. Every round is written to the shared folder.
    Null ends and loops are dropped; nodes that only have loops are not returned.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = materialize(e, f"{label}-0")
    mark = None
    for step in range(1, 64):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{label}-{step}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("u"), "v")
    return e.unionByName(roots).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


# ---------------------------------------------------------------- bounded blocks, best rows of a group


def bounded_blocks(df: DataFrame, weight: str, cap: int, label: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(df written with a number `no` for each row, ranges of `no` whose rows weigh cap at most, or are one row).

    Running sums stay inside a task's part of the table; the driver sees a range for each part or each cap of weight."""
    part, no = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("no")
    numbered = materialize(df.select("*", part, no), label)
    run = F.sum(weight).over(Window.partitionBy("_part").orderBy("no"))
    cuts = (
        numbered.select("no", "_part", weight, run.alias("run")).withColumn("cut", F.floor((F.col("run") - 1) / cap))
        .groupBy("_part", "cut").agg(F.min("no").alias("lo"), F.max("no").alias("hi"), F.sum(weight).alias("w")).orderBy("lo").collect()
    )
    out: list[list[int]] = []
    for r in cuts:
        if out and out[-1][2] + r["w"] <= cap:
            out[-1] = [out[-1][0], r["hi"], out[-1][2] + r["w"]]
        else:
            out.append([r["lo"], r["hi"], r["w"]])
    return numbered.drop("_part"), [(lo, hi) for lo, hi, _ in out]


#: Groups are first cut down in so many parts each.
RANK_PARTS = 32


def best_rows(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group with their rank, cut down by parts of a group first, so that no task meets a whole one."""
    part = F.pmod(F.monotonically_increasing_id().bitwiseXOR(F.shiftright(F.monotonically_increasing_id(), 33)), F.lit(RANK_PARTS))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    some = df.withColumn("_part", part).withColumn("rank", rank(*keys, "_part")).where(F.col("rank") <= k).drop("_part", "rank")
    return some.withColumn("rank", rank(*keys)).where(F.col("rank") <= k)


def keep_best(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k entries of each group by falling score, then rising ident, sorted so."""
    o = np.lexsort((ident, -score, group))
    group, score, ident = group[o], score[o], ident[o]
    first = np.searchsorted(group, group)
    keep = np.arange(len(group)) - first < k
    return group[keep], score[keep], ident[keep]

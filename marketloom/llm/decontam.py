"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern is a run of item words: every window of `window` words, or a whole shorter item. Patterns are grouped by
length m. Over a text, the search looks at the block of two words that ends at a position: a block that no pattern of
the group has shifts by up to m - 1 words, a block that ends patterns opens the bucket of that suffix, and each bucket
entry is compared word by word. Items are cut into parts of bounded size that share window - 1 words, so that each window
lies in exactly one part, and parts are put together by running size into blocks of bounded size. A block reaches the tasks,
which build their tables themselves; the driver holds one block at a time. A larger benchmark takes more passes over
the documents; each pass writes the hits it finds, which are summed by document at the end.

Defined results: a null text or an item without words has no words, hits or windows; repeated items are one item per
item_id; repeated documents are judged one by one (rows that share a doc_id get one row each as long as the benchmark
fits one block, and are numbered to stay apart otherwise); an empty benchmark leaves every document clean; columns
besides doc_id, text, item_id, whatever their names, are ignored; a very long text is a step of its own, a very long item
is cut into parts (a window's words alone may pass the bound); items with equal windows are all found.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_blocks, map_arrow, materialize, text_chunks

#: Bytes of item words that one pass holds in each task (their tables take some 80 times as much), and those of one part of an item.
BLOCK_BYTES, PART_BYTES = 4 << 20, 1 << 20

_table = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _table[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _table[_c] = _c + 32
WORD_TABLE = bytes(_table)


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, as UTF-8."""
    return (text or "").encode().translate(WORD_TABLE).split()


class WuManber:
    """Patterns of one length m: block shift table and suffix buckets."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], m: int):
        self.m, self.block = m, min(2, m)
        self.longest = m - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        for p, items in patterns.items():
            for end in range(self.block, m + 1):
                key = p[end - 2 : end] if self.block == 2 else p[end - 1]
                self.shift[key] = min(self.shift.get(key, self.longest), m - end)
            self.buckets[p[-2:] if self.block == 2 else p[-1]].append((p, items))

    def search(self, text: list[bytes], hit: bytearray, found: set[str]) -> None:
        m, get, longest, pair = self.m, self.shift.get, self.longest, self.block == 2
        at, n, ones = m, len(text), b"\x01" * self.m
        while at <= n:
            key = (text[at - 2], text[at - 1]) if pair else text[at - 1]
            step = get(key, longest)
            if step:
                at += step
                continue
            start = at - m
            seen = tuple(text[start:at])
            for p, items in self.buckets[key]:
                if p == seen:
                    hit[start:at] = ones
                    found |= items
            at += 1


def build(items: list[tuple[str, list[bytes]]], window: int) -> list[WuManber]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, w in items:
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            by_length[m][tuple(w[k : k + m])].add(item)
    return [WuManber(p, m) for m, p in sorted(by_length.items())]


_built: dict[str, list[WuManber]] = {}


def machines_of(held, window: int) -> list[WuManber]:
    """The tables of a broadcast block of items, built once in each Python worker, which keeps those of one block."""
    key, items = held.value
    if key not in _built:
        _built.clear()
        _built[key] = build([(item, words(text)) for item, text in items], window)
    return _built[key]


def item_parts(text: str, window: int, limit: int) -> Iterator[bytes]:
    """The words of an item in parts of limit bytes (or of one window), so that each of its windows lies in one part."""
    w = words(text)
    upto = [0, *accumulate(len(x) + 1 for x in w)]  # bytes of the first words
    first, n = 0, max(1, len(w) - window + 1) if w else 0
    while first < n:
        end = max(first + window, bisect_right(upto, upto[first] + limit) - 1)
        yield b" ".join(w[first:end])
        first = end - window + 1


def item_blocks(benchmark: DataFrame, window: int, limit: int, part_bytes: int = PART_BYTES) -> list[DataFrame]:
    """Blocks of (item_id as string, words of a part), of limit bytes at most, or of one part."""
    rows = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")

    def run(batches):
        for part, col in text_chunks(batches, "text"):
            cut = [(item, p) for item, text in zip(part.column(0).to_pylist(), col.to_pylist(), strict=True) for p in item_parts(text, window, part_bytes)]
            items, texts = [i for i, _ in cut], [p.decode() for _, p in cut]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string()), pa.array([len(p) for _, p in cut], pa.int64())], ["item", "text", "size"])

    parts, ranges = bounded_blocks(map_arrow(rows, run, "item string, text string, size long"), "size", limit, "item-parts")
    parts = parts.drop("size")
    return [parts.where(F.col("no").between(lo, hi)).drop("no") for lo, hi in ranges] or [parts.where("false").drop("no")]


def held(block: DataFrame):
    """A block as a broadcast; its size has a bound."""
    items = sorted(tuple(r) for r in block.collect())
    return block.sparkSession.sparkContext.broadcast((hashlib.sha256(repr(items).encode()).hexdigest(), items))


def search(text: str, machines: list[WuManber]) -> tuple[int, bytearray, set[str]]:
    """(words, mark of each word that is hit, items) of one text."""
    w = words(text)
    hit, found = bytearray(len(w)), set()
    for x in machines:
        x.search(w, hit, found)
    return len(w), hit, found


def scan(docs: DataFrame, block: DataFrame, window: int) -> DataFrame:
    """doc_id, row, n_words, hits (covered word indices), items of docs(doc_id, row, text) for one block."""
    schema, items_held = "doc_id long, row long, n_words long, hits array<int>, items array<string>", held(block)

    def run(batches):
        machines = machines_of(items_held, window)
        for part, col in text_chunks(batches, "text"):
            n_words, hits, items = [], [], []
            for text in col.to_pylist():
                n, hit, found = search(text, machines)
                n_words.append(n)
                hits.append([i for i, v in enumerate(hit) if v] if found else [])
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "row", "n_words", "hits", "items"],
            )

    return map_arrow(docs, run, schema)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted), contaminated."""
    return _judge(docs, item_blocks(benchmark, window, block_bytes, part_bytes), window)


def _judge(docs: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    one = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text")
    if len(blocks) == 1:
        out = scan(one, blocks[0], window)
    else:
        one = materialize(one, "numbered")  # so that a row keeps its number in every pass
        out = materialize(scan(one, blocks[0], window), "hits-0")
        for k, block in enumerate(blocks[1:], 1):
            out = out.unionByName(materialize(scan(one, block, window).where("size(items) > 0"), f"hits-{k}"))
        out = out.groupBy("doc_id", "row").agg(
            F.max("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    n_hit = F.size("hits").cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def filter_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that are not contaminated (20 * hit words < words), all columns unchanged.

    One pass judges rows in place. With more blocks of items, contaminated row numbers are joined out.
    """
    blocks = item_blocks(benchmark, window, block_bytes)
    if len(blocks) > 1:
        marked = materialize(docs.withColumn("_loom_row", F.monotonically_increasing_id()), "marked")
        keyed = marked.select(F.col("_loom_row").alias("doc_id"), "text")
        bad = _judge(keyed, blocks, window).where("contaminated")
        return marked.join(bad.select(F.col("doc_id").alias("_loom_row")), "_loom_row", "left_anti").drop("_loom_row")
    items_held = held(blocks[0])

    def run(batches):
        machines = machines_of(items_held, window)
        for part, col in text_chunks(batches, "text"):
            keep = []
            for text in col.to_pylist():
                n, hit, _ = search(text, machines)
                marks = hit.count(1)
                keep.append(not (marks and 20 * marks >= n))
            yield part.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def items_digest(items: F.Column) -> F.Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = 13) -> tuple[int, int, list[str]]:
    """(words, hit words, items) by plain comparison; for tests."""
    w, hit, found = words(text), set(), set()
    for item, item_text in items:
        p = words(item_text)
        m = min(window, len(p))
        for k in range(len(p) - m + 1 if m else 0):
            for s in range(len(w) - m + 1):
                if w[s : s + m] == p[k : k + m]:
                    hit |= set(range(s, s + m))
                    found.add(item)
    return len(w), len(hit), sorted(found)


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()

"""Substring dedup by level-wise doubling of repeated word windows.

Windows of half the length come first: of the half windows inside each full window the one with the smallest hash is
chosen, so equal full windows choose equal halves and a fifth of the halves is shuffled. Halves that occur in one
document alone are done; only the others are extended to the full window, and full windows that repeat in a document
with a smaller doc_id are removed. Longer levels change no removal, since every longer repeat consists of full windows;
`repeat_levels` goes on to twice the length, over and over, until no window survives.

Keys are combined by partial minima before each shuffle, so a passage that a third of all documents share is one row
per task; keys with very many rows are joined by broadcast (their number has a bound), all others by a shuffle, after a
Bloom filter has dropped the windows that occur once. Texts without a repeated window are not shuffled.

Defined results: a null or empty text has no words; windows need 13 words of one document; rows that share a doc_id
are taken as copies of one row and never remove each other's words; of equal windows the smallest doc_id keeps its own;
a null doc_id neither removes nor is removed; a very long text is a step of its own; an empty table gives no rows; other
columns, whatever their names, are ignored or passed on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, join_hot, map_arrow, materialize, maybe_in, split_in, text_chunks

WINDOW = 13


def chosen(w: Words, window: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts of full windows, the half window that each chooses, all half-window hashes by word, text of each)."""
    at, h = w.grams(half)
    hashes = np.full(len(w.hashes), np.uint64(2**64 - 1))
    hashes[at] = h
    span = window - half + 1
    n = len(w.hashes) - window + 1
    owner = w.text_of_word()
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, hashes, owner
    view = np.lib.stride_tricks.sliding_window_view(hashes, span)[:n]
    last = np.repeat(w.first[1:], w.counts())[:n]
    starts = np.flatnonzero(np.arange(n) + window <= last)
    pick = np.empty(len(starts), np.int64)
    for a in range(0, len(starts), 1 << 17):
        s = starts[a : a + (1 << 17)]
        pick[a : a + len(s)] = view[s].argmin(1) + s
    return starts, pick, hashes, owner


def half_windows(docs: DataFrame, window: int, half: int) -> DataFrame:
    """(hash, doc_id, at): the chosen half windows, each once per document and hash."""

    def run(batches):
        for part, col in text_chunks(batches, "text"):
            w = Words(col)
            _, pick, hashes, owner = chosen(w, window, half)
            at = np.unique(pick)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[at].view(np.int64)), pa.array(ids[owner[at]]), pa.array((at - w.first[owner[at]]).astype(np.int32))],
                ["hash", "doc_id", "at"],
            )

    return map_arrow(docs, run, "hash long, doc_id long, at int")


def full_windows(docs: DataFrame, window: int, half: int) -> DataFrame:
    """(hash, doc_id, at) of the full windows of docs(doc_id, text, halves) whose chosen half is in halves."""

    def run(batches):
        for part, col in text_chunks(batches, "text"):
            w = Words(col)
            starts, pick, _, owner = chosen(w, window, half)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            alive = np.zeros(len(w.hashes) + 1, bool)
            lists = part.column(2)
            sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            halves = lists.flatten().to_numpy(zero_copy_only=False)
            alive[within(w, sizes, halves)] = True
            keep = alive[pick]
            starts = starts[keep]
            places, grams = w.grams(window)
            everywhere = np.zeros(len(w.hashes), np.uint64)
            everywhere[places] = grams
            yield pa.RecordBatch.from_arrays(
                [pa.array(everywhere[starts].view(np.int64)), pa.array(ids[owner[starts]]), pa.array((starts - w.first[owner[starts]]).astype(np.int32))],
                ["hash", "doc_id", "at"],
            )

    return map_arrow(docs, run, "hash long, doc_id long, at int")


def within(w: Words, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places in each text (sizes[d] of them for text d) as places in the chunk; places past a text's end are dropped."""
    place = np.repeat(w.first[:-1], sizes) + at.astype(np.int64)
    return place[place < np.repeat(w.first[1:], sizes)]


def shared(windows: DataFrame) -> DataFrame:
    """(hash, first_doc, n) of the windows that start in two documents or more; n rows have it."""
    ends = windows.groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n"))
    return ends.where("first_doc < last_doc").select("hash", "first_doc", "n")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """windows(hash, doc_id, at, first_doc) that start in two documents or more; first_doc is the smallest of them.

    Half windows are made twice rather than stored: they are the largest intermediate by far."""
    half = window // 2
    one = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    halves = half_windows(one, window, half)
    again = materialize(shared(halves), "halves-again")
    some = materialize(maybe_in(halves, "hash", again), "halves")
    alive = join_hot(some, again, "hash", "n", some.count()).groupBy("doc_id").agg(F.collect_list("at").alias("halves"))
    alive = materialize(alive, "alive")
    some = maybe_in(one, "doc_id", alive).hint("merge").join(alive, "doc_id")
    full = materialize(full_windows(some.select("doc_id", "text", "halves"), window, half), "windows")
    again = materialize(shared(full), "windows-again")
    return join_hot(full, again, "hash", "n", full.count()).drop("n")


def repeat_levels(repeats: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, at, words): every repeated window at each level of window, 2 * window, 4 * window, ... words.

    repeats: those of the first level. A level reads the one before it, no text."""
    level = materialize(repeats.select("hash", "doc_id", "at"), f"level-{window}")
    out, size = None, window
    while out is None or not level.isEmpty():
        rows = level.select("doc_id", "at", F.lit(size).alias("words"))
        out = rows if out is None else out.unionByName(rows)
        after = level.select("doc_id", (F.col("at") - size).alias("at"), F.col("hash").alias("next"))
        twice = level.hint("merge").join(after, ["doc_id", "at"]).select(F.xxhash64("hash", "next").alias("hash"), "doc_id", "at")
        size *= 2
        twice = materialize(twice, f"twice-{size}")
        again = materialize(shared(twice), f"again-{size}")
        level = materialize(join_hot(twice, again, "hash", "n", twice.count()).select("hash", "doc_id", "at"), f"level-{size}")
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text (words joined by one blank)."""
    cut = repeated_windows(docs, window).where("doc_id > first_doc").groupBy("doc_id").agg(F.collect_list("at").alias("cuts"))
    cut = materialize(cut, "cuts")
    some, other = split_in(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", cut)
    rows = some.hint("merge").join(cut, "doc_id", "left").select("doc_id", "text", "cuts")
    rows = rows.unionByName(other.select("doc_id", "text", F.lit(None).cast("array<int>").alias("cuts")))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"

    def run(batches):
        for part, col in text_chunks(batches, "text"):
            w = Words(col)
            counts = w.counts()
            edge = np.zeros(len(w.hashes) + window + 1, np.int64)
            sizes = np.asarray(part.column(2).value_lengths().fill_null(0)).astype(np.int64)
            at = within(w, sizes, part.column(2).flatten().to_numpy(zero_copy_only=False))
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            gone = np.cumsum(edge)[: len(w.hashes)] > 0
            raw, kept, removed = w.buf.tobytes(), [], []
            for d in range(len(w)):
                i = np.arange(w.first[d], w.first[d + 1])[~gone[w.first[d] : w.first[d + 1]]]
                removed.append(int(counts[d]) - len(i))
                kept.append(b" ".join(raw[s:e] for s, e in zip(w.starts[i].tolist(), w.ends[i].tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode() for x in kept], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return map_arrow(rows, run, schema)

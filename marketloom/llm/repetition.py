"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, counted over whole texts.

Defined results: a null text has no words and fails the base rule (n_words < 50); an empty text likewise. A text of
any length is hashed in steps of bounded memory. Rows are judged one by one, so repeated rows and repeated ids give
equal rows, an empty table gives none, and further columns of the input are ignored or passed on by `filter_quality`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, map_arrow, span_hashes, text_chunks


@dataclass(frozen=True)
class QualityRules:
    """Limits of the verdict; shares are of the characters in words."""

    min_words: int = 50
    max_repeat_words: float = 0.5
    #: n-gram length -> largest share of characters inside n-grams that occur twice or more
    max_gram_share: tuple[tuple[int, float], ...] = ((5, 0.50), (7, 0.45), (10, 0.40))
    max_line_share: float = 0.40
    max_symbols_per_word: float = 0.25


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " gram_shares array<double>, line_share double, base_failed boolean, kept boolean"
)

_symbol = np.zeros(256, bool)
_symbol[list(b"#*$%&|<>")] = True


def _repeated(hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether each hash occurs twice or more within its group; groups ascend."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) < 2:
        return out
    order = np.lexsort((hashes, group))
    h, g = hashes[order], group[order]
    same = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out[order] = twice
    return out


def _covered(w: Words, n: int) -> np.ndarray:
    """Words that lie in an n-word window found twice or more in the same text."""
    at, h = w.grams(n)
    words = len(w.hashes)
    bad = at[_repeated(h, w.text_of_word()[at])] if len(at) else at
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, bad, 1)
    np.add.at(edge, bad + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, end byte) of each \\n-split line that has a word."""
    cut = np.flatnonzero(w.buf == 10)
    starts = np.unique(np.concatenate([w.offsets[:-1], cut + 1]))
    starts = starts[starts < len(w.buf)]
    owner = np.searchsorted(w.offsets, starts, "right") - 1
    ends = np.minimum(np.append(cut, len(w.buf))[np.searchsorted(cut, starts, "left")], w.offsets[owner + 1])
    has = np.searchsorted(w.starts, ends, "left") > np.searchsorted(w.starts, starts, "left")
    starts, ends = starts[has], ends[has]
    return np.searchsorted(w.offsets, starts, "right") - 1, starts, ends


def measure(col: pa.Array, rules: QualityRules) -> dict[str, np.ndarray]:
    w = Words(col)
    docs = len(w)
    owner = w.text_of_word()
    per = lambda values: np.bincount(owner, values, docs) if len(owner) else np.zeros(docs)
    lead = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
    chars = lead[w.ends] - lead[w.starts]
    marks = np.concatenate([[0], np.cumsum(_symbol[w.buf])])
    n_words, word_chars = w.counts(), per(chars).astype(np.int64)
    text, a, b = _lines(w)
    h = span_hashes(w.buf, a, b)
    order = np.lexsort((np.arange(len(h)), h, text))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    line_chars = np.bincount(text, (lead[b] - lead[a]) * again, docs) if len(text) else np.zeros(docs)
    total = np.maximum(word_chars, 1)
    shares = np.stack([per(chars * _covered(w, n)) / total for n, _ in rules.max_gram_share], 1)
    repeat = per(_covered(w, 3)).astype(np.int64)
    symbols = marks[w.offsets[1:]] - marks[w.offsets[:-1]]
    failed = (n_words < rules.min_words) | (repeat > rules.max_repeat_words * n_words)
    over = (shares > np.array([s for _, s in rules.max_gram_share])).any(1)
    over |= line_chars / total > rules.max_line_share
    over |= symbols > rules.max_symbols_per_word * n_words
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols,
        "n_dup_lines": np.bincount(text, again, docs).astype(np.int64) if len(text) else np.zeros(docs, np.int64),
        "n_repeat_words": repeat, "gram_shares": shares, "line_share": line_chars / total,
        "base_failed": failed, "kept": ~failed & ~over,
    }


def repetition_coverage(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document of docs(doc_id, text): counts, coverage by n-gram length, base rule and verdict."""

    def run(batches):
        for part, col in text_chunks(batches, "text"):
            m = measure(col, rules)
            g = m.pop("gram_shares")
            shares = pa.ListArray.from_arrays(np.arange(0, g.size + 1, g.shape[1], dtype=np.int32), g.ravel())
            cols = {"doc_id": part.column(0), **{k: pa.array(v) for k, v in m.items()}, "gram_shares": shares}
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([cols[k] for k in names], names)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def filter_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of docs that the verdict keeps, all columns unchanged; judged where they are, without a shuffle."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches):
        for part, col in text_chunks(batches, schema[at].name):
            yield part.filter(pa.array(measure(col, rules)["kept"]))

    return map_arrow(docs, run, schema)

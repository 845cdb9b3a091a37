"""Language identification by compression: the language whose raw-content dictionary shrinks a text most.

Each language has a zstandard dictionary of raw text: its most frequent words over the whole texts of all labelled rows,
DICT_BYTES of them, the most frequent last. A text is compressed in pieces with every dictionary, by one setting for all
texts; the smallest sum wins, and the margin to the second gives the score and the rejection. Bounds of what is learned:
DICT_BYTES a language, the LANGUAGES languages with most rows, words of WORD_CHARS letters at most.

Defined results: null texts and texts without a letter are `und` with score 0; without training rows everything is
`und`; very long texts are compressed piece by piece; equal sums go to the alphabetically first language, equally
frequent words to a dictionary by a hash; repeated rows and ids count and answer like any others; an empty table gives
none; lang, source and doc_id are never read for a prediction, and other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, materialize, text_chunks

DICT_BYTES = 96 << 10
LANGUAGES, WORD_CHARS = 200, 40
PIECE_CHARS = 4096
#: A margin of fewer bits per byte than this between the two best languages is narrow.
NARROW = 0.02
LEVEL = 5
#: Words of one language whose counts fall in one of these many cells of a power of two go to a dictionary together.
CELLS = 1024
_OTHER = re.compile(r"[\W\d_]+")


def fold(doc_id: F.Column) -> F.Column:
    """0, 1 or 2 from the id; 1 is held out from training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def frequent_words(labelled: DataFrame, dict_bytes: int = DICT_BYTES, languages: int = LANGUAGES) -> DataFrame:
    """(lang, word, n): each language's most frequent words, dict_bytes in all at most.

    Counts are exact; they are cut by a histogram of counts and hash cells, so no task sorts a language's words."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    top = rows.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(languages)
    plain = F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " ")
    words = rows.join(F.broadcast(top.select("lang")), "lang").select("lang", F.explode(F.split(F.trim(plain), " ")).alias("word"))
    words = words.where(F.length("word").between(1, WORD_CHARS)).groupBy("lang", "word").agg(F.count("*").alias("n"))
    cell = F.pmod(F.xxhash64("word"), F.lit(CELLS))
    words = materialize(words.select("lang", "word", "n", F.floor(F.log2("n")).alias("level"), cell.alias("cell")), "language-words")
    cells = words.groupBy("lang", "level", "cell").agg(F.sum(F.octet_length("word") + 1).alias("bytes"))
    w = W.partitionBy("lang").orderBy(F.desc("level"), "cell")
    taken = cells.withColumn("so_far", F.sum("bytes").over(w)).where(F.col("so_far") <= dict_bytes)
    return words.join(F.broadcast(taken.select("lang", "level", "cell")), ["lang", "level", "cell"]).select("lang", "word", "n")


def fit(labelled: DataFrame, dict_bytes: int = DICT_BYTES, languages: int = LANGUAGES) -> dict[str, bytes]:
    """language -> dictionary bytes. The driver gets dict_bytes of each language at most."""
    out: dict[str, list[str]] = {}
    for lang, _, word in sorted((r["lang"], r["n"], r["word"]) for r in frequent_words(labelled, dict_bytes, languages).collect()):
        out.setdefault(lang, []).append(word)
    return {k: f" {' '.join(v)} ".encode() for k, v in out.items()}


@lru_cache(maxsize=4)
def compressors(dictionaries: tuple[tuple[str, bytes], ...]):
    """[(language, compressor)]."""
    params = zstd.ZstdCompressionParameters.from_level(LEVEL, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    out = []
    for lang, raw in dictionaries:
        d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append((lang, zstd.ZstdCompressor(dict_data=d, compression_params=params)))
    return out


def normalize(text: str) -> str:
    """Lower case, everything but letters as one blank: marks and case say nothing about a language."""
    return _OTHER.sub(" ", text.lower())


def classify(text: str, machines) -> tuple[str, str | None, float, bool]:
    """(language, second language, score, rejected) of one text."""
    plain = normalize(text)
    if not machines or not any(map(str.isalpha, plain)):
        return "und", None, 0.0, True
    pieces = [plain[i : i + PIECE_CHARS].encode() for i in range(0, len(plain), PIECE_CHARS)]
    sizes = sorted((sum(len(c.compress(p)) for p in pieces), lang) for lang, c in machines)
    n = sum(map(len, pieces))
    best = sizes[0][0]
    score = 1 / sum(math.exp(-min(50.0, 200 * (s - best) / (n + 40))) for s, _ in sizes)
    second = sizes[1] if len(sizes) > 1 else None
    return sizes[0][1], second and second[1], score, second is not None and 8 * (second[0] - best) / n < NARROW


def predict(docs: DataFrame, dictionaries: dict[str, bytes], reject: bool = True) -> DataFrame:
    """doc_id, lang_pred, second, score, rejected; reject: a narrow margin gives `und` instead of the best language."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))
    schema = "doc_id long, lang_pred string, second string, score double, rejected boolean"

    def run(batches):
        machines = compressors(held.value)
        for part, col in text_chunks(batches, "text"):
            rows = [classify(t, machines) for t in col.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(["und" if reject and r[3] else r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.float64()),
                    pa.array([r[3] for r in rows], pa.bool_()),
                ],
                ["doc_id", "lang_pred", "second", "score", "rejected"],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)

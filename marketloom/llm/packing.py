"""Sequence packing by power-of-two decomposition.

Each document is cut into pieces whose lengths are powers of two (whole pieces of max_len first, then the binary
digits of the rest, longest first). A piece is a sequence of its own: none crosses documents and none needs padding.
Pieces of equal length share a bucket, from which batches of equal length are drawn.

Defined results: a null or empty text is the end token alone; the cut depends on the document only, so repeated rows
give equal pieces under sequence ids of their own; a null doc_id stays null; an empty table gives no piece; other
columns of the input are ignored. Long texts are encoded in slices that are cut where two words meet, which changes
no id.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_chunks

#: Pre-tokenization pattern of the byte-level vocabulary; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters that both libraries class alike (letters, digits, ASCII marks and blanks, common punctuation).
PLAIN = re.compile(
    "[\t-\r -~À-ɏΑ-ΡΣ-ωЀ-џ–—‘-„†-•…"
    "ぁ-ゖァ-ヺ一-龥가-힣]*"
)
SEAM = re.compile(r"(?<=[a-z]) (?=[a-z])")
SLICE_CHARS = 1 << 20


@lru_cache(maxsize=2)
def load_encoders(path: str):
    """(tokenizer, the same vocabulary as byte ranks in the faster library, special strings) of a tokenizer file."""
    import tiktoken
    from tokenizers import Tokenizer

    model = json.loads(open(path, encoding="utf-8").read())
    special = {t["content"] for t in model["added_tokens"]}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable}
    to_byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(path), fast, tuple(special)


def slices(text: str, size: int = SLICE_CHARS) -> list[str]:
    """The text cut before a blank between two letters, where the pattern always starts anew."""
    out, at = [], 0
    while len(text) - at > size and (m := SEAM.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def encode(text: str, path: str) -> np.ndarray:
    """The tokenizer's ids without special tokens. Plain texts take the faster library, which gives the same ids."""
    slow, fast, special = load_encoders(path)
    if PLAIN.fullmatch(text) and not any(s in text for s in special):
        parts = [np.asarray(fast.encode_ordinary(x), np.uint32) for x in slices(text)]
    else:
        parts = [np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def cuts(n: int, max_len: int) -> list[int]:
    """Piece lengths of a document of n tokens: whole pieces, then the binary digits of the rest."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset[, ids].

    bucket is log2(length). sequence_id comes from the task and the row in it, so it takes no shuffle, and a task that
    runs again gives the same ids.
    """
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for part, col in text_chunks(batches, "text"):
            rows: list[list] = [[] for _ in names]
            kept: list[np.ndarray] = []
            for doc, text in zip(part.column(0).to_pylist(), col.to_pylist(), strict=True):
                ids = np.append(encode(text, tokenizer_path), np.uint32(end_id)).astype("<u4")
                raw, start = memoryview(ids.tobytes()), 0
                for n in cuts(len(ids), max_len):
                    crc = zlib.crc32(raw[4 * start : 4 * (start + n)])
                    for x, v in zip(rows, (doc, start, n, crc, len(ids), n.bit_length() - 1), strict=True):
                        x.append(v)
                    if with_ids:
                        kept.append(ids[start : start + n].astype(np.int32))
                    start += n
            types = [pa.int64()] * 5 + [pa.int32()]
            arrays = [pa.array(x, t) for x, t in zip(rows, types, strict=True)]
            if with_ids:
                ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(ends, np.concatenate(kept) if kept else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

    pieces = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema + ", ids array<int>" * with_ids)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces with ids as Parquet, one folder for each length, ready for batches of equal length."""
    pieces.write.partitionBy("bucket").parquet(path)

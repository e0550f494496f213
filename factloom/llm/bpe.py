"""Operator 2: byte-level BPE encoding and decoding by a monoid tree reduction.

A text is cut into halves until the pieces are short; each piece is encoded by
itself, and neighbours are joined by encoding again a window around the seam.
The split pattern never matches a non-space character followed by white space,
so each change from non-space to white space is a token boundary of *every* text
around it (an anchor).  The window grows, doubling, until it reaches an anchor on
both sides or the end of the pieces: what lies outside is then the same tokens in
the joined text, so join is associative and its result is the library's.
Decoding is the same tree with byte concatenation as the join.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table, worker_cache

#: Characters of a leaf of the tree.
LEAF_CHARS = 4096
#: Characters of the first window on each side of a seam.
WINDOW_CHARS = 32


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """The library's encoder for a rank file, kept for the worker's life."""
    cache = worker_cache()
    if ("bpe", path) not in cache:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        cache["bpe", path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache["bpe", path]


def _is_anchor(text: str, at: int) -> bool:
    return text[at] in " \t\n\r" and not text[at - 1].isspace()


def _left_anchor(text: str, begin: int, seam: int) -> int:
    """The last anchor in (begin, seam), or begin."""
    reach = WINDOW_CHARS
    high = seam
    while True:
        low = max(begin + 1, seam - reach)
        for at in range(high - 1, low - 1, -1):
            if _is_anchor(text, at):
                return at
        if low == begin + 1:
            return begin
        high, reach = low, reach * 2


def _right_anchor(text: str, seam: int, end: int) -> int:
    """The first anchor in (seam, end), or end."""
    reach = WINDOW_CHARS
    low = seam + 1
    while True:
        high = min(end, seam + 1 + reach)
        for at in range(low, high):
            if _is_anchor(text, at):
                return at
        if high == end:
            return end
        low, reach = high, reach * 2


def encode_tree(text: str, encode, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """Token ids of the whole text; ``encode`` maps a string to its ids."""

    def reduce(begin: int, end: int) -> list[int]:
        if end - begin <= leaf_chars:
            return encode(text[begin:end])
        seam = (begin + end) // 2
        left, right = reduce(begin, seam), reduce(seam, end)
        low, high = _left_anchor(text, begin, seam), _right_anchor(text, seam, end)
        kept = len(left) - len(encode(text[low:seam]))
        skipped = len(encode(text[seam:high]))
        del left[kept:]
        left += encode(text[low:high])
        left += right[skipped:]
        return left

    return reduce(0, len(text))


def decode_tree(ids: np.ndarray, decode, leaf_ids: int = LEAF_CHARS) -> bytes:
    """Bytes of the ids, concatenated up the tree."""
    if len(ids) <= leaf_ids:
        return decode(ids.tolist())
    half = len(ids) // 2
    return decode_tree(ids[:half], decode, leaf_ids) + decode_tree(ids[half:], decode, leaf_ids)


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text.

    A null text counts as empty and has no ids; repeated rows each give a row.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            ids = [encode_tree(t or "", encode) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, ids array<int>").withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every id array; null ids give an empty text."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(path).decode_bytes
        for batch in batches:
            texts = [decode_tree(np.asarray(x or [], np.int64), decode).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    source = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("i"))
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of every text.

    One pass, no shuffle: ids are hashed as little-endian unsigned 32-bit
    integers, and what is hashed as decoded comes from those ids alone.

    Null and empty texts have no ids, and the hashes of no bytes.  Every row has a row,
    repeated ones and those without a doc_id too; a text of any length is encoded whole;
    an empty table gives none; columns besides doc_id and text are ignored.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                count, id_sums, text_sums, kept = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = np.asarray(encode_tree(text or "", enc.encode_ordinary), "<u4")
                    count.append(len(ids))
                    id_sums.append(hashlib.sha256(ids).hexdigest())
                    text_sums.append(hashlib.sha256(decode_tree(ids, enc.decode_bytes)).hexdigest())
                    if with_ids:
                        kept.append(ids.astype(np.int32))
                arrays = [part.column(0), pa.array(count, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))

"""Operator 9: token-ID files by bit-plane shuffling.

Documents are ordered by doc_id into shards; a shard's ids run through its documents
and are cut into blocks of a fixed number of ids.  A block is transposed into planes
(plane b holds bit b, or byte b, of every id) and each plane is compressed with
zstandard by itself: the high planes are nearly constant and vanish.

Layout of a written folder (``FORMAT``), a Parquet table so that Spark's commit
protocol keeps lost or repeated tasks from leaving partial files:

- ``blocks``: shard, block, first_id (ids of the shard before it), n_ids, plane_bits
  (1 or 8), plane_sizes array<int>, planes (the compressed planes end to end) and
  docs, the chunk index: doc_id, seq, first_id and n_ids of every document that has
  ids in the block.  Shards are numbered in the order of doc_id.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import scratch_dir, slices, table, text_bytes, worker_cache

FORMAT = "bit planes 1"
#: Ids of a block, bits of a plane, and bits of an id.
BLOCK_IDS = 65_536
PLANE_BITS = 8
ID_BITS = 32
#: Ends each document.
END_ID = 1
#: Words that a worker remembers; beyond it the memory is emptied.
CACHE_WORDS = 1_500_000
#: Bytes of text encoded at once, and new words that the library gets in one string.
TEXT_BYTES = 1 << 22
WORDS_AT_ONCE = 256
SEAM = "\x01"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts by the tokenizers library, a word at a time.

    The vocabulary's rules never look across ASCII white space (it is dropped, and no
    composition or pattern spans it), so a text's ids are those of its words in turn,
    and a word seen before need not be encoded again.  Strings of special tokens hold no
    white space either; they become the special ids, as by the library's default.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # A word of its own whose ids mark the seams when many words are encoded at once.
        self.seam = self.library.encode(SEAM, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word)."""
        run = self.library.encode_batch_fast
        if len(self.seam) != 1 or any(SEAM in w for w in words):
            found = [x.ids for x in run(words, add_special_tokens=False)]
            return np.array([y for x in found for y in x], np.uint32), np.array([len(x) for x in found], np.int64)
        between = f" {SEAM} "
        lines = [between.join(words[i : i + WORDS_AT_ONCE]) + between for i in range(0, len(words), WORDS_AT_ONCE)]
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in run(lines, add_special_tokens=False)])
        seams = np.flatnonzero(ids == self.seam[0])
        if len(seams) != len(words):
            raise ValueError("the vocabulary does not keep words apart")
        return np.delete(ids, seams), np.diff(seams, prepend=-1) - 1

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of rows in them), without end ids; null is empty."""
        lists = pc.ascii_split_whitespace(column.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.number) + len(names) > CACHE_WORDS:
            self.clear()
        numbers = list(map(self.number.get, names))
        fresh = [i for i, n in enumerate(numbers) if n is None]
        if fresh:
            base = len(self.number)
            words = [names[i] for i in fresh]
            ids, lengths = self._encode_words(words)
            for at, (i, w) in enumerate(zip(fresh, words, strict=True), base):
                numbers[i] = self.number[w] = at
            self.starts = np.concatenate([self.starts, np.cumsum(lengths) + self.starts[-1]])
            self.ids = np.concatenate([self.ids, ids])
        number = np.array(numbers, np.int64)[coded.indices.to_numpy()] if names else np.zeros(0, np.int64)
        starts = self.starts[number]
        lengths = self.starts[number + 1] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return self.ids[at], np.concatenate([[0], ends])[offsets]


def word_encoder(path: str) -> WordEncoder:
    cache = worker_cache()
    if ("words", path) not in cache:
        cache["words", path] = WordEncoder(path)
    return cache["words", path]


def packed_block(ids: np.ndarray, plane_bits: int = PLANE_BITS) -> tuple[list[int], bytes]:
    """(size of each plane, planes) of a block; planes run from the lowest bits up."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    planes = np.unpackbits(raw, axis=1, bitorder="little") if plane_bits == 1 else raw
    squeeze = zstandard.ZstdCompressor(level=3).compress
    out = [squeeze(np.packbits(p).tobytes() if plane_bits == 1 else p.tobytes()) for p in np.ascontiguousarray(planes.T)]
    return [len(x) for x in out], b"".join(out)


def unpacked_block(sizes: list[int], data: bytes, n: int, plane_bits: int = PLANE_BITS) -> np.ndarray:
    ends = np.cumsum(sizes)
    expand = zstandard.ZstdDecompressor().decompress
    planes = [np.frombuffer(expand(data[end - size : end]), np.uint8) for end, size in zip(ends.tolist(), sizes, strict=True)]
    if plane_bits == 8:
        return np.ascontiguousarray(np.stack(planes).T).view("<u4").ravel()
    bits = np.stack([np.unpackbits(p, count=n) for p in planes])
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u4").ravel()


def _id_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two byte strings end to end, from theirs and the second's length:
    the first is multiplied by x**(8 * length) modulo the crc's polynomial."""

    def times(matrix: list[int], vector: int) -> int:
        out, i = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[i]
            vector >>= 1
            i += 1
        return out

    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        step = [times(step, x) for x in step]  # one zero byte
    while second_bytes:
        if second_bytes & 1:
            first = times(step, first)
        step = [times(step, x) for x in step]
        second_bytes >>= 1
    return first ^ second


def write(docs: DataFrame, path: str, vocabulary: str | None = None, block_ids: int = BLOCK_IDS, plane_bits: int = PLANE_BITS) -> None:
    """Writes ids of every text, each ended by END_ID, in ascending doc_id order.

    A null text is empty; null doc_ids come first; rows of the same doc_id follow one
    another in the order of their texts, each with its own entry.  Strings of special
    tokens in a text become their ids, as the library does by default.  A range partition
    is a shard, so a task holds one block and one chunk of text at a time; a very long text
    is encoded alone.  An empty table gives no block.
    """
    vocabulary = vocabulary or vocabulary_path()
    kind = dict(docs.dtypes)["doc_id"]
    id_type = _id_type(kind)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = word_encoder(vocabulary).encode
        schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("plane_bits", pa.int32()), ("plane_sizes", pa.list_(pa.int32())), ("planes", pa.binary()), ("docs", pa.list_(pa.struct([("doc_id", id_type), ("seq", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64())])))])
        waiting, waiting_ids = [], 0
        entries = deque()  # documents that reach beyond what is written
        written, block, seq, position = 0, 0, 0, 0

        def emit(ids):
            nonlocal block, written
            end, inside = written + len(ids), []
            while entries and entries[0]["first_id"] < end:
                inside.append(entries[0])
                if entries[0]["first_id"] + entries[0]["n_ids"] > end:
                    break
                entries.popleft()
            sizes, planes = packed_block(ids, plane_bits)
            row = {"shard": shard, "block": block, "first_id": written, "n_ids": len(ids), "plane_bits": plane_bits, "plane_sizes": sizes, "planes": planes, "docs": inside}
            block, written = block + 1, end
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            texts = batch.column(1)
            _, offsets = text_bytes(texts)
            for low, high in slices(np.diff(offsets), TEXT_BYTES):
                ids, at = encode(texts.slice(low, high - low))
                keys = batch.column(0).slice(low, high - low).to_pylist()
                n = np.diff(at)
                full = np.full(len(ids) + len(n), END_ID, np.uint32)
                full[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                for key, size in zip(keys, (n + 1).tolist(), strict=True):
                    entries.append({"doc_id": key, "seq": seq, "first_id": position, "n_ids": size})
                    seq, position = seq + 1, position + size
                waiting.append(full)
                waiting_ids += len(full)
                if waiting_ids >= block_ids:
                    stream = np.concatenate(waiting)
                    whole = len(stream) // block_ids * block_ids
                    for cut in range(0, whole, block_ids):
                        yield emit(stream[cut : cut + block_ids])
                    waiting, waiting_ids = [stream[whole:]], len(stream) - whole
        if waiting_ids:
            yield emit(np.concatenate(waiting))

    schema = f"shard long, block long, first_id long, n_ids long, plane_bits int, plane_sizes array<int>, planes binary, docs array<struct<doc_id: {kind}, seq: long, first_id: long, n_ids: long>>"
    ordered.mapInArrow(run, schema).write.parquet(f"{path}/blocks", compression="none")


def blocks_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/blocks")


def _bases(blocks: DataFrame) -> DataFrame:
    """shard, base: ids of all shards before it; one row for each shard goes to one task."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    running = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    return totals.select("shard", (running - F.col("ids")).alias("base"))


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, shard, seq, first_id (within the shard), n_ids, start (over all shards)."""
    blocks = blocks_of(spark, path)
    entries = blocks.select("shard", F.col("first_id").alias("at"), F.explode("docs").alias("d")).where("d.first_id >= at").select("shard", "d.*")
    return entries.join(_bases(blocks), "shard").withColumn("start", F.col("base") + F.col("first_id"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    A block is expanded where it lies and cut at the borders of the documents that it
    names; the pieces of a document that runs over blocks meet as checksums.
    """
    blocks = blocks_of(spark, path)
    kind = dict(blocks.select(F.expr("docs[0].doc_id as doc_id")).dtypes)["doc_id"]
    id_type = _id_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("piece", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("doc_id", id_type), ("first_id", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpacked_block(row["plane_sizes"], row["planes"], row["n_ids"], row["plane_bits"])
                begin, end = row["first_id"], row["first_id"] + row["n_ids"]
                out = []
                for e in row["docs"]:
                    low, high = max(begin, e["first_id"]), min(end, e["first_id"] + e["n_ids"])
                    crc = zlib.crc32(np.ascontiguousarray(ids[low - begin : high - begin], "<u4"))
                    out.append((row["shard"], e["seq"], low, high - low, crc, e["doc_id"], e["first_id"]))
                columns = [pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    pieces = blocks.mapInArrow(run, f"shard long, seq long, piece long, n long, crc long, doc_id {kind}, first_id long")
    whole = pieces.groupBy("shard", "seq", "doc_id", "first_id").agg(F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("piece", "n", "crc"))).alias("pieces"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for parts in batch.column(4).to_pylist():
                crc = parts[0]["crc"]
                for p in parts[1:]:
                    crc = joined_crc(crc, p["crc"], 4 * p["n"])
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], names=["shard", "doc_id", "first_id", "n_tokens", "ids_crc32"])

    summed = whole.select("shard", "doc_id", "first_id", "n_tokens", "pieces").mapInArrow(join, f"shard long, doc_id {kind}, first_id long, n_tokens long, ids_crc32 long")
    return summed.join(_bases(blocks), "shard").select("doc_id", (F.col("base") + F.col("first_id")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return read_back(spark, path)

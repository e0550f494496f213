"""Helpers that several operators share: scratch tables, text chunks, word hashing."""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.graph import scratch_dir, shuffled

#: Bytes of text that a task works on at once; a longer document is taken alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later jobs neither
    recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """Shuffle partitions, as whoever runs the job sized them for the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    return sys.__dict__.setdefault("_factloom_worker_cache", {})


def slices(lengths: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths add up to ``limit`` or less (or one longer row)."""
    ends = np.cumsum(lengths)
    begin = 0
    while begin < len(lengths):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield begin, end
        begin = end


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, row offsets) of a string column; null rows count as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or len(at) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


#: Bytes between words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, row) of each word; words do not run over rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[data]
    rows = offsets[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(rows, starts, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Powers of a base that a worker keeps; longer tables are made for one use.
KEPT_POWERS = 1 << 17


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base is odd)."""
    have = worker_cache().setdefault("powers", {})
    if n > KEPT_POWERS:
        return _powers(base, n)
    if base not in have:
        have[base] = _powers(base, KEPT_POWERS)
    up, down = have[base]
    return up[:n], down[:n]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        both.append(np.multiply.accumulate(x))
    return both[0], both[1]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of values[start:end], all from one prefix sum."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mixed((sums[ends] - sums[starts]) * down[starts] + lengths * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(hashes: np.ndarray, rows: np.ndarray, size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every run of ``size`` words that stays within one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return at, span_hashes(hashes, at, at + size, base)


#: Bytes up to which a word is hashed eight bytes at a time, with all others.
SHORT_WORD = 32


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word data[start:end]; different ``which`` are independent.

    Every eight bytes are mixed with their place before they are added, so the sum has no
    structure that words could share; a word of eight bytes or fewer never meets another of
    its length.  Longer words than ``SHORT_WORD`` are hashed by BLAKE2b.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))  # the eight bytes from each on
    out = np.empty(len(starts), np.uint64)
    for low in range(0, len(starts), 1 << 18):
        first, size = starts[low : low + (1 << 18)], (ends - starts)[low : low + (1 << 18)]
        total = size.astype(np.uint64)
        for i in range(SHORT_WORD // 8):
            more = np.flatnonzero(size > 8 * i) if i else slice(None)
            cut = ((8 - np.minimum(size[more] - 8 * i, 8)) * 8).astype(np.uint64)
            place = (which * 64 + i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            total[more] += mixed((at[first[more] + 8 * i] << cut >> cut) + np.uint64(place))
        out[low : low + (1 << 18)] = mixed(total)
    for i in np.flatnonzero(ends - starts > SHORT_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        out[i] = int.from_bytes(digest[8 * which : 8 * which + 8], "little")
    return out


def even_keys(spark: SparkSession, partitions: int, each: int) -> DataFrame:
    """(number, key) for partitions * each numbers from 0; hash partitioning deals the keys
    out evenly: ``each`` to every partition."""
    n = spark.range(partitions * each * 64).withColumn("p", F.pmod(F.hash("id"), F.lit(partitions)))
    ranked = n.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("id"))).where(F.col("r") <= each)
    return ranked.select((F.col("p") * each + F.col("r") - 1).cast("long").alias("number"), F.col("id").alias("key"))


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", sizes: DataFrame | None = None) -> DataFrame:
    """``big`` joined to ``small`` by ``keys``, though one key may hold most rows of ``big``.

    A key with more rows than an even share of the shuffle partitions is cut into as many
    parts as it has shares, and its rows of ``small`` are copied to each part.  There are
    fewer such keys than partitions, so they are broadcast.  Rows are counted in ``sizes``,
    a written table with the keys of ``big``, or else in ``big``, which is then read twice.
    """
    counted = (big if sizes is None else sizes).select(*keys)
    share = max(1, -(-counted.count() // width(big.sparkSession)))
    many = counted.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > share)
    hot = F.broadcast(many.select(*keys, F.ceil(F.col("_n") / share).cast("int").alias("_parts")))
    dealt = big.join(hot, keys, "left").withColumn("_part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    copied = small.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return dealt.join(shuffled(copied), [*keys, "_part"], how).drop("_part")

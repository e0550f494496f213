"""The job queue: duplicates, superseded jobs and rate-limited notices.

The batch forms are windows over a finished log.  The streaming forms keep state for
what may still come, bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators.graph import stored


def deduplicated_stream(jobs: DataFrame, key: list[str], at: str, window: str = "10 minutes") -> DataFrame:
    """Jobs of a stream whose key was not seen within the window."""
    return jobs.withWatermark(at, window).dropDuplicatesWithinWatermark(key)


def notices_stream(jobs: DataFrame, key: str, at: str, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """key, first and jobs for each burst: jobs of a key with no more than ``gap`` between
    them make one notice, however long the burst is (``rate_limited_stream`` notifies again
    after the gap)."""
    return jobs.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.min(at).alias("first"), F.count("*").alias("jobs")).select(key, "first", "jobs")


def rate_limited_stream(events: DataFrame, key: str, at: str, gap: int, late: str = "10 minutes") -> DataFrame:
    """key and at (seconds) of the events of a stream that may notify, as ``rate_limited``
    gives them for the whole log.

    Events are held until the watermark has passed them, so they are judged in the order of
    their times however they arrive; what comes later than ``late`` is left out, as Spark
    does.  A key's state is what it holds and its last notice, and is dropped when the gap
    after that is over.  A key of null is a key like any other.
    """
    kind = dict(events.dtypes)[key]
    seen = events.withWatermark(at, late).select(F.struct(F.col(key).alias("k")).alias("_k"), F.col(at).alias("_at"), F.unix_seconds(at).alias("_s"))

    def judge(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, "")
        waiting = {int(x) for x in held.split(",") if x}
        for batch in batches:
            waiting.update(batch["_s"].dropna().astype("int64").tolist())
        passed = state.getCurrentWatermarkMs() // 1000
        found = []
        for second in sorted(x for x in waiting if x < passed):
            if last is None or second - last >= gap:
                found.append(second)
                last = second
        waiting = sorted(x for x in waiting if x >= passed)
        if not waiting and (last is None or last + gap < passed):
            if state.exists:
                state.remove()
        else:
            state.update((last, ",".join(map(str, waiting))))
            wake = waiting[0] if waiting else last + gap
            state.setTimeoutTimestamp(max((wake + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        value = group[0]["k"] if isinstance(group[0], dict) else group[0][0]
        yield pd.DataFrame({key: pd.Series([value] * len(found), dtype="object"), "at": pd.Series(found, dtype="int64")})

    return seen.groupBy("_k").applyInPandasWithState(judge, f"{key} {kind}, at long", "last long, held string", "append", GroupStateTimeout.EventTimeTimeout)


def deduplicated(jobs: DataFrame, key: list[str], at: list[str]) -> DataFrame:
    """The first job of every key."""
    w = Window.partitionBy(*key).orderBy(*at)
    return jobs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def superseded(jobs: DataFrame, group: list[str], order: list[str], head: str, before: str) -> DataFrame:
    """Jobs that the next job of their group replaces: it starts where they end."""
    w = Window.partitionBy(*group).orderBy(*order)
    return jobs.withColumn("_next", F.lead(before).over(w)).where(F.col("_next") == F.col(head)).drop("_next")


def rate_limited(events: DataFrame, key: str, seconds: str, gap: int) -> DataFrame:
    """key and seconds of the events that may notify: the first of a key, and each that
    comes ``gap`` seconds or more after the last that did.

    Different seconds are sorted into ranges, and a task folds its range.  A key within
    one range is done by that.  The first and the last key of a range may lie in others
    too; for those the range tells its exits: which second is the last to notify if this
    or that is the first, in runs of the same answer.  The ranges of each such key are then
    passed in order (a few runs for each; at worst, where events come at every second,
    ``gap`` of them), which gives the time from which each range may notify, and their rows
    are folded again from there.  So no task holds a key, and the jobs are the same few
    however many events there are.
    """
    held = F.struct(F.col(key).alias("k"))  # a null key is a key too
    different = events.select(held.alias("_k"), F.col(seconds).cast("bigint").alias("_s")).where("_s is not null").distinct()
    ranged = different.repartitionByRange("_k", "_s").sortWithinPartitions("_k", "_s").withColumn("_b", F.spark_partition_id())
    kind = different.schema["_k"].dataType.simpleString()
    folded = stored(ranged.mapInArrow(_folds(to_arrow_schema(ranged.schema), max(gap, 1)), f"_k {kind}, _s long, _b int, _exit long, _kind int"))
    starts = folded.where(F.col("_kind") == EXITS).groupBy("_k").applyInArrow(_entries(max(gap, 1)), f"_k {kind}, _b int, _from long")
    unsure = folded.where(F.col("_kind") == UNSURE).select("_k", "_b", "_s").join(F.broadcast(starts), ["_k", "_b"])  # a number for each range
    again = unsure.groupBy("_k", "_b").applyInArrow(_notifying(max(gap, 1)), f"_k {kind}, _s long")
    found = folded.where(F.col("_kind") == SURE).select("_k", "_s").unionByName(again)
    return found.select(F.col("_k.k").alias(key), F.col("_s").alias(seconds))


#: Rows of a folded range: seconds that notify, seconds of keys that may lie in more
#: ranges, and the exits of those keys (_s is the last of a run of seconds).
SURE, UNSURE, EXITS = 0, 1, 2


def _chain(ahead: np.ndarray, at: int) -> np.ndarray:
    """The places from ``at`` on, each the one that ``ahead`` names for the last."""
    found = []
    while at < len(ahead):
        found.append(at)
        at = int(ahead[at])
    return np.array(found, np.int64)


def _exits(s: np.ndarray, ahead: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(second, exit): the exit of a chain that begins at any second after the one before
    up to this.  Only seconds at which a chain from an earlier range can begin are told."""
    ends = np.arange(len(s))
    for at in range(len(s) - 1, -1, -1):
        if ahead[at] < len(s):
            ends[at] = ends[ahead[at]]
    ends = ends[: int(np.searchsorted(s, s[0] + gap)) + 1]
    last = np.flatnonzero(np.append(ends[1:] != ends[:-1], True))
    return s[last], s[ends[last]]


def _folds(schema: pa.Schema, gap: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema=schema).combine_chunks()  # a range
        if not rows.num_rows:
            return
        s, keys = rows.column("_s").to_numpy(), rows.column("_k").to_pylist()
        begins = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        sure, unsure = [], []
        for low, high in zip(begins[:-1], begins[1:], strict=True):
            part = s[low:high]
            ahead = np.searchsorted(part, part + gap)
            if 0 < low and high < len(keys):
                sure.append(low + _chain(ahead, 0))
                continue
            unsure.append(np.arange(low, high))
            seconds, exits = _exits(part, ahead, gap)
            told = rows.slice(low, 1).take(pa.array(np.zeros(len(seconds), np.int64)))
            yield from _marked(told.set_column(1, "_s", pa.array(seconds)), exits, EXITS)
        for places, what in ((sure, SURE), (unsure, UNSURE)):
            if places:
                yield from _marked(rows.take(pa.array(np.concatenate(places))), None, what)

    return fold


def _marked(rows: pa.Table, exits: np.ndarray | None, what: int) -> list[pa.RecordBatch]:
    exits = pa.nulls(rows.num_rows, pa.int64()) if exits is None else pa.array(exits, pa.int64())
    return rows.append_column("_exit", exits).append_column("_kind", pa.array(np.full(rows.num_rows, what, np.int32))).combine_chunks().to_batches()


def _entries(gap: int):
    def pass_ranges(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_b", "ascending"), ("_s", "ascending")])
        of, s, exits = (rows.column(c).to_numpy() for c in ("_b", "_s", "_exit"))
        starts, last = [], None
        for b in np.unique(of):
            low, high = np.searchsorted(of, b), np.searchsorted(of, b, "right")
            at = low if last is None else low + int(np.searchsorted(s[low:high], last + gap))
            starts.append(np.iinfo(np.int64).min if last is None else last + gap)
            last = int(exits[at]) if at < high else last
        return pa.table({"_k": rows.column("_k").take(pa.array(np.zeros(len(starts), np.int64))), "_b": pa.array(np.unique(of), pa.int32()), "_from": pa.array(starts, pa.int64())})

    return pass_ranges


def _notifying(gap: int):
    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_s")
        s, start = rows.column("_s").to_numpy(), rows.column("_from")[0].as_py()
        return rows.take(pa.array(_chain(np.searchsorted(s, s + gap), int(np.searchsorted(s, start))))).select(["_k", "_s"])

    return fold

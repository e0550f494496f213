"""Unified diffs: diffs(id, text) to files, hunks and lines with their numbers.

What a line means depends on the header before it, so the lines of a diff are read in their
order, a diff at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

HUNK = re.compile(r"@@ -([0-9]+)(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@")
KINDS = {"+": "add", "-": "del", " ": "context"}
#: Diffs whose files are given on at once.
DIFFS = 256
LINES = "array<struct<hunk: bigint, type: string, old_line: int, new_line: int, text: string>>"


def _files(text: str) -> list[dict]:
    """a, b (names as written) and lines of each file of a diff that has a header."""
    out, name = [], {}
    at = {"headed": False, "hunk": 0, "lines": []}

    def close():
        if at["headed"] and at["lines"]:
            out.append({"a": name.get("--- "), "b": name.get("+++ "), "lines": at["lines"]})

    old = new = 0
    for line in text.split("\n"):
        start = HUNK.match(line)
        if line.startswith("diff --git "):
            close()
            name, at = {}, {"headed": True, "hunk": 0, "lines": []}
        elif start:
            at["hunk"] += 1
            old, new = int(start[1]), int(start[2])
        elif not at["hunk"]:
            at["headed"] = True
            if line[:4] in ("--- ", "+++ "):
                name[line[:4]] = max(name.get(line[:4], ""), line[4:])
        elif line[:1] in KINDS:
            kind = KINDS[line[0]]
            at["lines"].append({"hunk": at["hunk"], "type": kind, "old_line": None if kind == "add" else old, "new_line": None if kind == "del" else new, "text": line[1:]})
            old, new = old + (kind != "add"), new + (kind != "del")
    close()
    return out


def diff_lines(diffs: DataFrame) -> DataFrame:
    """id, path, old_path, hunk, type (add, del or context), old_line, new_line, text."""
    line = pa.struct([("hunk", pa.int64()), ("type", pa.string()), ("old_line", pa.int32()), ("new_line", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, DIFFS):
                part = batch.slice(first, DIFFS)
                found = [(i, f) for i, text in enumerate(part.column(1).to_pylist()) if text is not None for f in _files(text)]
                ids = part.column(0).take(pa.array([i for i, _ in found], pa.int32()))
                columns = [pa.array([f[k] for _, f in found], t) for k, t in (("a", pa.string()), ("b", pa.string()), ("lines", pa.list_(line)))]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["id", "a", "b", "lines"])

    schema = StructType([StructField("id", diffs.schema["id"].dataType), *StructType.fromDDL(f"a string, b string, lines {LINES}").fields])
    read = diffs.select("id", "text").where("id is not null").mapInArrow(run, schema)
    clean = lambda c: F.when(F.col(c) != "/dev/null", F.regexp_replace(F.regexp_replace(c, r'\t.*$|^"|"$', ""), "^[ab]/", ""))
    named = read.select("id", clean("a").alias("old_path"), clean("b").alias("path"), F.explode("lines").alias("l"))
    return named.select("id", F.coalesce("path", "old_path").alias("path"), "old_path", "l.*")


def added(lines: DataFrame) -> DataFrame:
    return lines.where("type = 'add'").select("id", "path", F.col("new_line").alias("line"), "text")


def removed(lines: DataFrame) -> DataFrame:
    return lines.where("type = 'del'").select("id", F.coalesce("old_path", "path").alias("path"), F.col("old_line").alias("line"), "text")


def base_text(head: DataFrame, changes: DataFrame) -> DataFrame:
    """path and lines (line, text) of the base: the head's lines that were not added, with
    removed ones put back at their numbers.  head(path, text), changes = diff_lines."""
    rows = head.select("path", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("new_line"), "text")
    kept = rows.join(changes.where("type = 'add'").select("path", "new_line"), ["path", "new_line"], "left_anti")
    gone = changes.where("type = 'del'").select(F.coalesce("old_path", "path").alias("path"), F.col("old_line").alias("line"), "text")
    # The k-th kept line takes the k-th number that no removed line has.
    w = Window.partitionBy("path").orderBy("new_line")
    numbered = kept.withColumn("k", F.row_number().over(w))
    holes = gone.groupBy("path").agg(F.array_sort(F.collect_set("line")).alias("taken"))
    shifted = numbered.join(holes, "path", "left")
    line = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("k"), lambda at, x: F.when(x <= at, at + 1).otherwise(at))
    return shifted.select("path", line.alias("line"), "text").unionByName(gone.select("path", "line", "text"))

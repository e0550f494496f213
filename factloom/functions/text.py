"""Text: display, escaping, hashes, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.values import once

#: Characters that are not seen or that reorder what is seen.
INVISIBLE = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f­؜​-‏‪-‮⁠-⁩﻿]"
STATEMENT_CHARS = 300
ERROR_CHARS = 200


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def byte_size(n: Column) -> Column:
    """0 B, 1.5 KiB, 2.0 MiB ..."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for unit, size in (("KiB", 1 << 10), ("MiB", 1 << 20), ("GiB", 1 << 30)):
        out = F.when(n >= size, F.concat(F.format_string("%.1f", n.cast("double") / size), F.lit(" " + unit))).otherwise(out)
    return out


def clean_statement(text: Column) -> Column:
    """Without invisible characters, white space collapsed, cut with an ellipsis; null if
    nothing is left."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), r"\s+", " "))
    cut = F.when(F.length(plain) > STATEMENT_CHARS, F.concat(F.substring(plain, 1, STATEMENT_CHARS - 1), F.lit("…"))).otherwise(plain)
    return F.when(plain != "", cut)


def one_line_error(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, ERROR_CHARS)


def line_of(text: Column, needle: Column) -> Column:
    """1-based line of the first occurrence, null without one."""
    at = F.instr(text, needle)
    before = F.substring(text, F.lit(1), at - 1)
    return F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)


def version_parts(version: Column) -> Column:
    """array<int> of the leading numbers of a version; null without any."""
    core = F.regexp_extract(version, r"^[vV=\s]*([0-9]+(?:\.[0-9]+)*)", 1)
    return once(core, lambda c: F.when(c != "", F.transform(F.split(c, r"\."), lambda x: x.try_cast("int"))))


def version_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 of two array<int>, the shorter padded with zeros; null for null."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.size(b))), lambda i: F.signum(F.coalesce(F.try_element_at(a, i), F.lit(0)) - F.coalesce(F.try_element_at(b, i), F.lit(0))))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_element_at(F.filter(pairs, lambda x: x != 0), F.lit(1)), F.lit(0.0)).cast("int"))


def satisfies(version: Column, range_: Column) -> Column:
    """'yes', 'no' or 'unknown' for the plain ranges: exact, ^, ~, >=, >, <=, <, *, x.  A
    partial version stands for all that begin with it, so >1 starts at 2.0.0."""
    sign = r"^\s*(\^|~|>=|<=|>|<|=)?\s*"
    plain = range_.rlike(sign + r"v?[0-9]+(\.[0-9]+){0,2}\s*$") & version.rlike(r"^v?[0-9]+\.[0-9]+\.[0-9]+$")
    read = F.struct(F.regexp_extract(range_, sign, 1).alias("operator"), version_parts(version).alias("v"), version_parts(F.regexp_replace(range_, sign, "")).alias("r"))
    filled = lambda r: F.concat(r, F.slice(F.array(*[F.lit(0)] * 3), F.lit(1), F.greatest(F.lit(3) - F.size(r), F.lit(0))))
    holds = once(read, lambda p: once(F.struct(p["operator"].alias("operator"), p["v"].alias("v"), filled(p["r"]).alias("full"), F.size(p["r"]).alias("fixed")), _holds))
    anything = range_.rlike(r"^\s*([*xX]|)\s*$")
    return F.when(anything, "yes").when(plain, F.when(holds, "yes").otherwise("no")).otherwise("unknown")


def _holds(p: Column) -> Column:
    """Whether version v is in the range that operator and full make; of full, the first
    ``fixed`` numbers are given."""
    operator, v, full, fixed = p["operator"], p["v"], p["full"], p["fixed"]
    order = version_compare(v, full)
    same = lambda n: F.slice(v, F.lit(1), n) == F.slice(full, F.lit(1), n)
    caret_keep = F.when(full[0] > 0, 1).when((full[1] > 0) | (fixed < 2), F.when(fixed < 2, 1).otherwise(2)).otherwise(F.when(fixed < 3, 2).otherwise(3))
    return (
        F.when(operator == "^", (order >= 0) & same(caret_keep))
        .when(operator == "~", (order >= 0) & same(F.least(fixed, F.lit(2))))
        .when(operator == ">=", order >= 0)
        .when(operator == "<=", (order <= 0) | same(fixed))
        .when(operator == ">", (order > 0) & ~same(fixed))
        .when(operator == "<", order < 0)
        .otherwise(same(fixed))
    )


def set_hash(values: Column) -> Column:
    """SHA-256 of a set of strings, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(values)), "\n"), 256)

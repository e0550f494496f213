"""Dependency manifests: files(path, text) to declared dependencies.

JSON manifests are parsed by Spark; the line formats are exploded to lines and read by
expressions; TOML is read by the standard library inside an Arrow function, a file at a
time, as nothing in Spark reads it.  A file that does not parse gives a row in
``problems`` and no exception.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import names, paths
from factloom.operators.graph import shuffled

# Sections of package.json in the order in which the first one counts.
JSON_SECTIONS = {"dependencies": "runtime", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional"}
COLUMNS = ["ecosystem", "project", "name", "constraint", "kind", "declared_in", "declared_line", "specifier_type"]


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _as(files: DataFrame, ecosystem: str) -> DataFrame:
    return files.withColumns({"ecosystem": F.lit(ecosystem), "project": paths.directory(F.col("path")), "declared_in": F.col("path")})


def package_json(files: DataFrame) -> DataFrame:
    """Dependencies of package.json files.  An optional dependency overrides a runtime one
    of its name; a constraint that is no string is left out (see ``problems``)."""
    rows = _as(files.where(paths.file_name(F.col("path")) == "package.json"), "javascript-typescript")
    rows = rows.withColumn("v", F.try_parse_json("text"))
    out = None
    for section, kind in JSON_SECTIONS.items():
        entries = F.try_variant_get("v", f"$.{section}", "map<string,string>")
        part = rows.select("ecosystem", "project", "declared_in", F.lit(kind).alias("kind"), F.lit(section).alias("section"), F.explode(entries).alias("name", "constraint"))
        out = part if out is None else out.unionByName(part)
    overridden = out.where("kind = 'optional'").select("declared_in", "name", F.lit("runtime").alias("kind"))
    kept = out.where("constraint is not null").join(shuffled(overridden), ["declared_in", "name", "kind"], "left_anti")
    placed = kept.join(shuffled(_json_lines(rows)), ["declared_in", "section", "name"], "left")
    return placed.withColumn("specifier_type", names.specifier_type(F.col("constraint"))).select(COLUMNS)


def _json_lines(rows: DataFrame) -> DataFrame:
    """declared_in, section, name and declared_line: where what stands in quotes is first,
    in each section of package.json and after.  A file is cut at its quotes once for each
    section, so a long one costs its length, not that times its dependencies."""
    each = rows.select("declared_in", "text", F.explode(paths.literal(JSON_SECTIONS)).alias("section"))
    start = F.instr("text", F.concat(F.lit('"'), "section", F.lit('"')))
    before = F.substring("text", F.lit(1), start - 1)
    above = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    cut = each.where(start > 0).select("declared_in", "section", (above + 1).alias("first"), F.posexplode(F.split(F.substring("text", start, F.length("text")), "\n")).alias("i", "t"))
    pieces = F.split("t", '"')
    quoted = cut.select("declared_in", "section", (F.col("first") + F.col("i")).alias("line"), F.explode(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))).alias("name"))
    return quoted.groupBy("declared_in", "section", "name").agg(F.min("line").cast("int").alias("declared_line"))


def problems(files: DataFrame) -> DataFrame:
    """path and statement of JSON manifests that do not parse or hold a constraint that
    is no string."""
    rows = files.where(paths.file_name(F.col("path")) == "package.json").withColumn("v", F.try_parse_json("text"))
    broken = rows.where("v is null").select("path", F.lit("the file is not valid JSON, or repeats a key").alias("statement"))
    out = broken
    for section in JSON_SECTIONS:
        each = rows.select("path", F.explode(F.try_variant_get("v", f"$.{section}", "map<string,variant>")).alias("name", "value"))
        odd = each.where(~F.schema_of_variant("value").isin("STRING")).select("path", F.concat(F.lit(f"{section}: the constraint of "), "name", F.lit(" is no string")).alias("statement"))
        out = out.unionByName(odd)
    return out


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1) and text of every line."""
    return files.select("path", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("_i", "text")).select("path", (F.col("_i") + 1).alias("line"), "text")


def requirement_kind(path: Column) -> Column:
    name = F.lower(paths.file_name(path))
    return F.when(name.rlike(r"(^|[-_.])(dev|devel|test|tests|testing|lint|docs?|ci)([-_.]|$)"), "dev").otherwise("runtime")


def requirements(files: DataFrame) -> DataFrame:
    """Named requirements of pip's requirements files, a line each, after continuation
    lines are joined.  Options and includes are not dependencies (see ``includes``)."""
    rows = _as(files.where(F.col("path").rlike(paths.REQUIREMENTS) | F.col("path").rlike(paths.REQUIREMENTS_DIRECTORY)), "python")
    joined = rows.withColumn("text", F.regexp_replace("text", r"\\\r?\n", "\u0001"))
    each = joined.select("ecosystem", "project", "declared_in", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("_i", "t"))
    # A joined line counts for the line at which it starts.
    w = Window.partitionBy("declared_in").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.length("t") - F.length(F.replace(F.col("t"), F.lit("\u0001"), F.lit("")))
    numbered = each.withColumn("declared_line", (F.col("_i") + 1 + F.coalesce(F.sum(extra).over(w), F.lit(0))).cast("int"))
    plain = _bare(F.regexp_replace(F.regexp_replace("t", "\u0001", " "), r"(^|\s)#.*$", ""))
    name = r"^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[[^\]]*\])?\s*"
    parsed = numbered.withColumn("p", plain).where(F.col("p").rlike(name + r"(@.+|[(<>=!~;].*)?$") & ~F.col("p").startswith("-"))
    rest = _bare(F.regexp_replace(F.regexp_replace("p", name, ""), r"\s*;.*$", ""))
    direct = F.col("constraint").startswith("@")
    kind = F.when(direct & F.col("constraint").rlike(r"^@\s*git\+"), "git").when(direct & F.col("constraint").rlike(r"^@\s*(file:|\.)"), "file").otherwise("registry")
    return parsed.withColumns({"name": names.python_name(F.regexp_extract("p", name, 1)), "constraint": rest, "kind": requirement_kind(F.col("declared_in"))}).withColumn("specifier_type", kind).select(COLUMNS)


def includes(files: DataFrame) -> DataFrame:
    """(path, included): -r and -c targets, relative to their file, that stay inside the
    repository; feed them to ``graph.closure`` for what a file includes in all."""
    each = lines(files.where(F.col("path").rlike(paths.REQUIREMENTS) | F.col("path").rlike(paths.REQUIREMENTS_DIRECTORY)))
    target = F.regexp_extract("text", r"^\s*(?:-r|-c|--requirement|--constraint)[\s=]*(\S+)", 1)
    folder = paths.directory(F.col("path"))
    full = F.when(folder == ".", F.col("target")).otherwise(F.concat_ws("/", folder, "target"))
    parts = F.filter(F.split(full, "/"), lambda x: (x != "") & (x != "."))
    up = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("inside"))
    walked = F.aggregate(parts, up, lambda s, x: F.when(x == "..", F.struct(F.slice(s["at"], F.lit(1), F.greatest(F.size(s["at"]) - 1, F.lit(0))).alias("at"), (s["inside"] & (F.size(s["at"]) > 0)).alias("inside"))).otherwise(F.struct(F.concat(s["at"], F.array(x)).alias("at"), s["inside"].alias("inside"))))
    found = each.withColumn("target", target).where("target != '' and target not like '%://%' and target not like '/%'")
    return found.withColumn("w", walked).where("w.inside").select("path", F.array_join("w.at", "/").alias("included"))


def go_mod(files: DataFrame) -> DataFrame:
    """Direct requirements of go.mod files; a replacement turns the specifier to file, or
    keeps registry with the new version.  An exact version's replacement beats a general."""
    rows = _as(files.where(paths.file_name(F.col("path")) == "go.mod"), "go")
    each = rows.select("ecosystem", "project", "declared_in", F.posexplode(F.split("text", "\r?\n")).alias("_i", "t"))
    opens = F.regexp_extract("t", r"^\s*(\w+)\s*\(\s*(?://.*)?$", 1)
    closes = F.col("t").rlike(r"^\s*\)\s*(//.*)?$")
    w = Window.partitionBy("declared_in").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    block = F.last(F.when(opens != "", opens).when(closes, ""), ignorenulls=True).over(w)
    verb = F.when(F.coalesce(F.col("block"), F.lit("")) != "", F.col("block")).otherwise(F.regexp_extract("t", r"^\s*(\w+)\s", 1))
    body = _bare(F.regexp_replace(F.when(F.coalesce(F.col("block"), F.lit("")) != "", F.col("t")).otherwise(F.regexp_replace("t", r"^\s*\w+\s+", "")), r"//.*$", ""))
    parsed = each.withColumn("block", block).withColumns({"verb": verb, "body": F.regexp_replace(body, "[\"`]", ""), "indirect": F.col("t").rlike(r"//\s*indirect\b")})
    need = parsed.where((F.col("verb") == "require") & F.col("body").rlike(r"^\S+\s+v\S+$") & ~F.col("indirect"))
    need = need.select("ecosystem", "project", "declared_in", (F.col("_i") + 1).cast("int").alias("declared_line"), F.split("body", r"\s+")[0].alias("name"), F.split("body", r"\s+")[1].alias("constraint"), F.lit("runtime").alias("kind"))
    new = parsed.where((F.col("verb") == "replace") & F.col("body").contains("=>"))
    old, target = F.split(_bare(F.split("body", "=>")[0]), r"\s+"), F.split(_bare(F.split("body", "=>")[1]), r"\s+")
    new = new.select("declared_in", old[0].alias("name"), F.try_element_at(old, F.lit(2)).alias("only"), target[0].alias("to"))
    best = new.groupBy("declared_in", "name", "only").agg(F.min("to").alias("to"))
    exact = best.where("only is not null").withColumnRenamed("only", "constraint").withColumnRenamed("to", "exact_to")
    general = best.where("only is null").drop("only").withColumnRenamed("to", "any_to")
    both = need.join(shuffled(exact), ["declared_in", "name", "constraint"], "left").join(shuffled(general), ["declared_in", "name"], "left")
    to = F.coalesce("exact_to", "any_to")
    return both.withColumn("specifier_type", F.when(to.rlike(r"^(\.{1,2}/|/|[A-Za-z]:)"), "file").otherwise("registry")).select(COLUMNS)


def _toml_rows(path: str, doc: dict) -> list[tuple]:
    """(name, constraint, kind, specifier) of the tables of one TOML manifest."""
    out: list[tuple] = []

    def entry(name, value, kind):
        if isinstance(value, str):
            out.append((name, value, kind, "registry"))
        elif isinstance(value, dict):
            where = "git" if "git" in value else "file" if "path" in value or "url" in value else "workspace" if value.get("workspace") is True else "registry"
            real = value.get("package")
            out.append((real if isinstance(real, str) else name, value.get("version") if isinstance(value.get("version"), str) else None, "optional" if value.get("optional") is True and kind == "runtime" else kind, where))
        elif isinstance(value, list):
            for v in value:
                entry(name, v, kind)

    def tables(doc, keys):
        for key, kind in keys:
            for name, value in (doc.get(key) or {}).items() if isinstance(doc.get(key) or {}, dict) else ():
                entry(name, value, kind)

    if path.endswith("Cargo.toml"):
        keys = (("dependencies", "runtime"), ("dev-dependencies", "dev"), ("build-dependencies", "build"))
        tables(doc, keys)
        for target in (doc.get("target") or {}).values():
            tables(target, keys)
    elif path.endswith("Pipfile"):
        tables(doc, (("packages", "runtime"), ("dev-packages", "dev")))
    else:
        project, poetry = doc.get("project") or {}, (doc.get("tool") or {}).get("poetry") or {}
        listed = [(x, "runtime") for x in project.get("dependencies") or []]
        listed += [(x, "optional") for group in (project.get("optional-dependencies") or {}).values() for x in group]
        listed += [(x, "dev") for group in (doc.get("dependency-groups") or {}).values() for x in group]
        listed += [(x, "build") for x in (doc.get("build-system") or {}).get("requires") or []]
        out += [(x, None, kind, "line") for x, kind in listed if isinstance(x, str)]
        tables({k: {n: v for n, v in (d or {}).items() if n != "python"} for k, d in poetry.items() if isinstance(d, dict)}, (("dependencies", "runtime"), ("dev-dependencies", "dev")))
        for group in (poetry.get("group") or {}).values():
            tables(group, (("dependencies", "dev"),))
    return out


def toml(files: DataFrame) -> DataFrame:
    """Dependencies of pyproject.toml, Pipfile and Cargo.toml; kind 'problem' and the
    reason in ``constraint`` for a file that does not parse."""
    wanted = paths.file_name(F.col("path")).isin("pyproject.toml", "Pipfile", "Cargo.toml")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tomllib

        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, *r) for r in _toml_rows(path, tomllib.loads(text or ""))]
                except (tomllib.TOMLDecodeError, AttributeError, TypeError) as e:
                    rows.append((path, None, str(e)[:200], "problem", "registry"))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["path", "name", "constraint", "kind", "specifier_type"])

    found = files.where(wanted).select("path", "text").mapInArrow(run, "path string, name string, constraint string, kind string, specifier_type string")
    cargo = F.col("path").endswith("Cargo.toml")
    line = F.col("specifier_type") == "line"
    pattern = r"^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[[^\]]*\])?\s*"
    rest = _bare(F.regexp_replace(F.regexp_replace("name", pattern, ""), r"\s*;.*$", ""))
    found = found.withColumn("constraint", F.when(line, rest).otherwise(F.col("constraint"))).withColumn("name", F.when(line, F.regexp_extract("name", pattern, 1)).otherwise(F.col("name")))
    kind = F.when(line, F.when(F.col("constraint").rlike(r"^@\s*git\+"), "git").when(F.col("constraint").rlike(r"^@\s*(file:|\.)"), "file").otherwise("registry")).otherwise(F.col("specifier_type"))
    ecosystem = F.when(cargo, "rust").otherwise("python")
    named = F.when(cargo, F.col("name")).otherwise(names.python_name(F.col("name")))
    return found.withColumns({"ecosystem": ecosystem, "project": paths.directory(F.col("path")), "declared_in": F.col("path"), "declared_line": F.lit(None).cast("int"), "name": named, "specifier_type": kind}).select(COLUMNS)


def declared(files: DataFrame) -> DataFrame:
    """Dependencies of all manifests that are not vendored."""
    own = files.where(~F.col("path").rlike(paths.VENDORED))
    toml_rows = toml(own).where("kind != 'problem'")
    return package_json(own).unionByName(requirements(own)).unionByName(go_mod(own)).unionByName(toml_rows)

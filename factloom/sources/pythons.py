"""Python projects: what their extras hold, the markers of their requirements, and the
least Python they declare."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import markers, names, paths
from factloom.operators import graph

NAME = r"^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)"
REQUIREMENT = NAME + r"\s*(?:\[([^\]]*)\])?\s*([^;]*?)\s*(?:;\s*(.*?)\s*)?$"

#: Files whose rows a task keeps for copies of them, and the longest of such.
KEPT_FILES = 8192
KEPT_CHARS = 2048


def listed(files: DataFrame, *sections: str) -> DataFrame:
    """project, section, extra and text of each pyproject.toml: name, requirement (runtime,
    or of an extra), requires-python and poetry's python; broken for one that does not
    parse.  A text is null where the file has something else.  What a file says again in
    the same words is one row.  With sections, only rows of those leave the reader."""
    table = lambda x: x if isinstance(x, dict) else {}
    string = lambda x: x if isinstance(x, str) else None
    many = lambda x: [s for s in x if isinstance(s, str)] if isinstance(x, list) else []

    def rows(text: str | None) -> Iterable[tuple[str, str | None, str | None]]:
        import tomllib

        try:
            doc = tomllib.loads(text or "")
        except tomllib.TOMLDecodeError:
            return [("broken", None, None)] if not sections or "broken" in sections else []
        project, poetry = table(doc.get("project")), table(table(table(doc.get("tool")).get("poetry")).get("dependencies"))
        out = [("name", None, string(project.get("name")))] + [("requirement", None, x) for x in many(project.get("dependencies"))]
        for extra, of in table(project.get("optional-dependencies")).items():
            out += [("extra", extra, None)] + [("requirement", extra, x) for x in many(of)]
        if "requires-python" in project:
            out.append(("requires-python", None, string(project["requires-python"])))
        if "python" in poetry:
            out.append(("poetry python", None, string(poetry["python"]) or string(table(poetry["python"]).get("version"))))
        return dict.fromkeys(r for r in out if not sections or r[0] in sections)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Copies of a file, as in two snapshots, are parsed once; what is kept is bounded.
        known = lru_cache(KEPT_FILES)(rows)
        for batch in batches:
            found = [(i, *r) for i, text in enumerate(batch.column(1).to_pylist()) for r in (known if len(text or "") <= KEPT_CHARS else rows)(text)]
            at, *columns = list(zip(*found, strict=True)) or [()] * 4
            project = batch.column(0).take(pa.array(at, pa.int64())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([project, *[pa.array(c, pa.string()) for c in columns]], names=["project", "section", "extra", "text"])

    return _own(files, "pyproject.toml").mapInArrow(run, "project string, section string, extra string, text string")


def _own(files: DataFrame, name: str) -> DataFrame:
    return files.where((paths.file_name(F.col("path")) == name) & ~paths.has_excluded_segment(F.col("path"))).select(paths.directory(F.col("path")).alias("project"), "text")


def _requirements(rows: DataFrame) -> DataFrame:
    part = lambda i: F.regexp_extract("text", REQUIREMENT, i)
    # Where the whole pattern fits, the name is what its beginning finds alone, and a marker
    # follows a semicolon: neither needs the whole pattern again.
    marker = F.nullif(F.when(F.col("text").contains(";"), part(4)).otherwise(""), F.lit(""))
    parsed = rows.where((F.col("section") == "requirement") & (part(1) != "")).select("project", F.when(F.col("extra").isNotNull(), names.python_name(F.col("extra"))).alias("extra"), names.python_name(F.regexp_extract("text", NAME, 1)).alias("name"), part(2).alias("extras"), part(3).alias("constraint"), marker.alias("marker"))
    return parsed.withColumn("extras", F.transform(F.filter(F.split("extras", r"\s*,\s*"), lambda x: F.trim(x) != ""), lambda x: names.python_name(F.trim(x))))


def conditions(files: DataFrame) -> DataFrame:
    """project, extra, name, valid and marker: the condition under which each requirement
    holds, of all its declarations.  A declaration of a marker that is none is not valid
    and is left out of the condition; if all are such, the condition is unknown (null) too."""
    rows = _requirements(listed(files, "requirement")).withColumn("fits", F.col("marker").isNull() | markers.is_marker(F.col("marker")))
    # In the order of their texts, as a table has no other; none stands as an empty text.
    by = rows.groupBy("project", "extra", "name").agg(F.bool_and("fits").alias("valid"), F.sort_array(F.collect_list(F.when(F.col("fits"), F.coalesce("marker", F.lit(""))))).alias("all"))
    return by.select("project", "extra", "name", "valid", markers.merged(F.when(~F.array_contains("all", ""), F.col("all"))).alias("marker"))


def extras(files: DataFrame) -> DataFrame:
    """project, extra and name: what each extra brings, with the extras of the project that
    it asks for by the project's own name, over any number of them; an extra that brings
    nothing has a row without a name."""
    rows = graph.stored(listed(files))
    own = rows.where("section = 'name' and text is not null").select("project", names.python_name(F.col("text")).alias("self"))
    given = rows.where("section = 'extra'").select("project", names.python_name(F.col("extra")).alias("extra")).distinct()
    asked = graph.stored(_requirements(rows).where("extra is not null").join(own, "project", "left"))
    itself = F.coalesce(F.col("name") == F.col("self"), F.lit(False))
    members = asked.where(~itself).select("project", "extra", "name").distinct()
    node = lambda c: F.concat_ws("\u0000", "project", c)
    edges = asked.where(itself).select("project", "extra", F.explode("extras").alias("to")).select(node("extra").alias("src"), node("to").alias("dst"))
    reach = graph.closure(edges).select(F.split("src", "\u0000")[0].alias("project"), F.split("src", "\u0000")[1].alias("extra"), F.split("dst", "\u0000")[1].alias("of"))
    more = reach.join(members.withColumnRenamed("extra", "of"), ["project", "of"]).select("project", "extra", "name")
    return given.join(members.unionByName(more).distinct(), ["project", "extra"], "left")


# Where a floor may stand; the first that is there decides.
PLACES = ["requires-python", "poetry python", "setup.py", "setup.cfg"]
SETUP_PY = r"""\bpython_requires\s*=\s*(?:(['"])([^'"\r\n]+)\1(?=\s*(?:[,)]|$)))?"""
SETUP_CFG = r"(?ms)^\[options\][ \t]*$(?:(?!^\[).)*?^python_requires[ \t]*[=:][ \t]*([^\n]*)"


def floors(files: DataFrame) -> DataFrame:
    """project, status, version, exclusive, constraint and place: the least Python of each
    project with a pyproject.toml, setup.py or setup.cfg.

    declared with the floor; unparsed where the first place that has a constraint has none
    that is understood (of setup.py, setup.cfg is asked then); absent without any."""
    rows = listed(files)
    toml = rows.where(F.col("section").isin(*PLACES, "broken")).select("project", F.when(F.col("section") == "broken", PLACES[0]).otherwise(F.col("section")).alias("place"), F.col("text").alias("constraint"))
    py = _own(files, "setup.py").where(F.col("text").rlike(r"\bpython_requires\s*=")).select("project", F.lit("setup.py").alias("place"), F.nullif(F.regexp_extract("text", SETUP_PY, 2), F.lit("")).alias("constraint"))
    cfg = _own(files, "setup.cfg").where(F.col("text").rlike(SETUP_CFG)).select("project", F.lit("setup.cfg").alias("place"), F.trim(F.regexp_extract("text", SETUP_CFG, 1)).alias("constraint"))
    rank = F.array_position(F.array(*[F.lit(p) for p in PLACES]), F.col("place"))
    each = toml.unionByName(py).unionByName(cfg).withColumns({"rank": rank, "floor": markers.floor(F.col("constraint"))})
    said = F.struct("rank", "place", "constraint", "floor")
    settled = F.col("floor").isNotNull() | (F.col("place") != "setup.py")
    best = each.groupBy("project").agg(F.coalesce(F.min(F.when(settled, said)), F.min(said)).alias("b"))
    all_ = _own(files, "pyproject.toml").unionByName(_own(files, "setup.py")).unionByName(_own(files, "setup.cfg")).select("project").distinct()
    status = F.when(F.col("b").isNull(), "absent").when(F.col("b.floor").isNull(), "unparsed").otherwise("declared")
    # A version as written in full; what is not there is 0.
    shown = F.array_join("b.floor.version", ".")
    return all_.join(best, "project", "left").select("project", status.alias("status"), shown.alias("version"), F.col("b.floor.exclusive").alias("exclusive"), F.col("b.constraint").alias("constraint"), F.col("b.place").alias("place"))

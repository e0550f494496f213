"""Source text: files(path, text) to references to packages.

The forms that name a package literally are found by patterns over the text, all inside
the JVM.  What they cannot see (computed names, shadowed bindings) is no reference; a
dynamic form without a literal is listed as a gap, never taken as absence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import names, paths, shell

JS_FILES = r"\.(?:[cm]?[jt]sx?|vue|svelte|astro)$"
# Each pattern has one group, the specifier.
JS_FORMS = {
    "static": [r"""(?m)^\s*(?:import|export)\s+(?:type\s+)?[\w*${},\s]*?\s*from\s*['"]([^'"\n]+)['"]""", r"""(?m)^\s*import\s*['"]([^'"\n]+)['"]"""],
    "require": [r"""\brequire(?:\.resolve)?\s*\(\s*['"]([^'"\n]+)['"]\s*\)""", r"""\b(?:jest|vi)\.(?:mock|doMock|unmock)\s*\(\s*['"]([^'"\n]+)['"]"""],
    "dynamic": [r"""\bimport\s*\(\s*['"]([^'"\n]+)['"]""", r"""\bimport\.meta\.resolve\s*\(\s*['"]([^'"\n]+)['"]"""],
}
JS_TYPE_ONLY = [r"""(?m)^\s*(?:import|export)\s+type\s+[^'";]*?from\s*['"]([^'"\n]+)['"]""", r"""(?m)^\s*///\s*<reference\s+types=['"]([^'"\n]+)['"]"""]
JS_GAP = r"""\b(?:require|import)\s*\(\s*[^'"\s)]"""
PY_IMPORT = r"(?m)^([ \t]*)import\s+([A-Za-z_][\w.]*(?:\s+as\s+\w+)?(?:\s*,\s*[A-Za-z_][\w.]*(?:\s+as\s+\w+)?)*)"
PY_FROM = r"(?m)^[ \t]*from\s+([A-Za-z_][\w.]*)\s+import\b"
PY_DYNAMIC = r"""\b(?:importlib\.import_module|__import__)\s*\(\s*['"]([A-Za-z_][\w.]*)['"]"""
GO_BLOCK = r"(?ms)^import\s*\((.*?)^\)"
GO_SINGLE = r"""(?m)^import\s+(?:[\w.]+\s+)?["`]([^"`\n]+)["`]"""
RUST_FORMS = [r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?:::)?([A-Za-z_]\w*)", r"(?m)^\s*(?:pub\s+)?extern\s+crate\s+([A-Za-z_]\w*)", r"(?<![\w:.$])([a-z_]\w*)::"]
RUST_OWN = ("crate", "self", "super", "Self", "std", "core", "alloc", "test", "proc_macro")


def _uncommented(text: Column, line: str) -> Column:
    """Without block and line comments; line breaks stay, so lines keep their numbers."""
    blocks = F.regexp_replace(text, r"(?s)/\*(?:(?!\*/)[^\n])*\*/", "")
    return F.regexp_replace(blocks, rf"(?m)(^|\s){line}[^\n]*$", "$1")


def javascript(files: DataFrame) -> DataFrame:
    """path, specifier, form, type_only, package and module kind of JS and TS files."""
    own = files.where(F.col("path").rlike(JS_FILES) & ~paths.has_excluded_segment(F.col("path"))).withColumn("text", _uncommented(F.col("text"), r"//(?!/\s*<reference)"))
    found = lambda pattern, form, types: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda s: F.struct(s.alias("specifier"), F.lit(form).alias("form"), F.lit(types).alias("types")))
    # Each text is read once: the matches of all patterns are listed together.
    all_ = [found(pattern, form, False) for form, patterns in JS_FORMS.items() for pattern in patterns] + [found(pattern, "static", True) for pattern in JS_TYPE_ONLY]
    each = own.select("path", F.explode(F.concat(*all_)).alias("m")).select("path", "m.*")
    both = each.groupBy("path", "specifier", "form").agg(F.count_if("types").alias("types"), F.count_if(~F.col("types")).alias("count"))
    return both.select("path", "specifier", "form", (F.col("types") >= F.col("count")).alias("type_only"), names.module_package(F.col("specifier")).alias("package"), names.module_kind(F.col("specifier")).alias("module_kind"))


def javascript_gaps(files: DataFrame) -> DataFrame:
    """path and n of dynamic forms whose argument is no literal."""
    own = files.where(F.col("path").rlike(JS_FILES))
    return own.select("path", F.regexp_count(_uncommented(F.col("text"), "//"), F.lit(JS_GAP)).alias("n")).where("n > 0")


def python(files: DataFrame) -> DataFrame:
    """path, module, form and conditional (an indented import) of Python files; strings
    in triple quotes and comments do not count, relative imports neither."""
    own = files.where(F.col("path").rlike(r"\.pyi?$"))
    bare = F.regexp_replace(F.regexp_replace("text", r"(?s)(\"\"\"|''').*?\1", '""'), r"(?m)#[^\n]*$", "")
    own = own.withColumn("text", bare)
    plain = own.select("path", F.explode(F.regexp_extract_all("text", F.lit(PY_IMPORT), F.lit(0))).alias("m"))
    each = plain.select("path", F.regexp_extract("m", r"^([ \t]*)", 1).alias("indent"), F.explode(F.split(F.regexp_replace("m", r"^\s*import\s+", ""), r"\s*,\s*")).alias("x"))
    imports = each.select("path", F.split("x", r"\s+")[0].alias("module"), F.lit("static").alias("form"), (F.col("indent") != "").alias("conditional"))
    froms = own.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*from\s+[A-Za-z_][\w.]*\s+import\b"), F.lit(0))).alias("m"))
    froms = froms.select("path", F.regexp_extract("m", PY_FROM, 1).alias("module"), F.lit("static").alias("form"), F.col("m").rlike(r"^[ \t]").alias("conditional"))
    dynamic = own.select("path", F.explode(F.regexp_extract_all("text", F.lit(PY_DYNAMIC), F.lit(1))).alias("module"), F.lit("dynamic").alias("form"), F.lit(False).alias("conditional"))
    return imports.unionByName(froms).unionByName(dynamic)


def python_distributions(imports: DataFrame, known: DataFrame, first_party: DataFrame) -> DataFrame:
    """``imports`` with the distribution that provides each module: none for first-party
    ones, else the longest dotted module of ``known`` (module, distribution), else the
    top-level name itself."""
    from factloom.operators.joins import longest_prefix

    own = imports.withColumn("top", names.top_module(F.col("module"))).join(first_party.select(F.col("module").alias("top"), F.lit(True).alias("own")).distinct(), "top", "left")
    matched = longest_prefix(own, known.withColumnRenamed("module", "known_module"), "module", "known_module", ".")
    named = matched.join(known.withColumnRenamed("module", "known_module"), "known_module", "left")
    return named.where("own is null").select(*imports.columns, names.python_name(F.coalesce("distribution", "top")).alias("distribution"))


def go(files: DataFrame) -> DataFrame:
    """path and module path of the imports of Go files that are not vendored."""
    own = files.where(F.col("path").rlike(r"\.go$") & ~F.col("path").rlike(r"(^|/)(vendor|testdata|[._][^/]*)/")).withColumn("text", _uncommented(F.col("text"), "//"))
    block = own.select("path", F.explode(F.regexp_extract_all("text", F.lit(GO_BLOCK), F.lit(1))).alias("b"))
    inside = block.select("path", F.explode(F.regexp_extract_all("b", F.lit(r"""["`]([^"`\n]+)["`]"""), F.lit(1))).alias("module"))
    return inside.unionByName(own.select("path", F.explode(F.regexp_extract_all("text", F.lit(GO_SINGLE), F.lit(1))).alias("module"))).distinct()


def rust(files: DataFrame) -> DataFrame:
    """path and crate root of the paths in Rust files, without the language's own."""
    own = files.where(F.col("path").rlike(r"\.rs$")).withColumn("text", F.regexp_replace(_uncommented(F.col("text"), "//"), r'"(?:[^"\\]|\\.)*"', '""'))
    out = None
    for pattern in RUST_FORMS:
        part = own.select("path", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("crate"))
        out = part if out is None else out.unionByName(part)
    return out.where(~F.col("crate").isin(*RUST_OWN)).distinct()


def _lexed(scripts: DataFrame) -> DataFrame:
    """path, name, commands and gaps of each script (see ``functions.shell``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shell.commands(x) for x in batch.column(2).to_pylist()]
            lists = [pa.array([f[i] for f in found], pa.list_(pa.string())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists], names=["path", "name", "commands", "gaps"])

    return scripts.select("path", "name", "script").mapInArrow(run, "path string, name string, commands array<string>, gaps array<string>")


def commands(scripts: DataFrame) -> DataFrame:
    """scripts(path, name, script) to path, name and each command word: what a shell would
    run, through assignments, groups, wrappers and scripts in arguments."""
    word = F.regexp_extract("c", r"^([@\w./-]+)", 1)
    return _lexed(scripts).select("path", "name", F.explode("commands").alias("c")).select("path", "name", word.alias("command")).where("command != ''")


def script_gaps(scripts: DataFrame) -> DataFrame:
    """path, name and reason of what in a script could not be read."""
    return _lexed(scripts).select("path", "name", F.explode(F.array_distinct("gaps")).alias("reason"))


def package_scripts(files: DataFrame) -> DataFrame:
    """path, name and script of package.json files."""
    own = files.where(paths.file_name(F.col("path")) == "package.json")
    return own.select("path", F.explode(F.try_variant_get(F.try_parse_json("text"), "$.scripts", "map<string,string>")).alias("name", "script"))


def workflow_steps(files: DataFrame) -> DataFrame:
    """path and script of the run: steps of CI workflows, single-line and block form."""
    own = files.where(F.col("path").rlike(r"^\.github/workflows/[^/]+\.ya?ml$"))
    single = own.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:-\s+)?run:\s*([^|>\s][^\n]*)$"), F.lit(1))).alias("script"))
    block = own.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^([ ]*)(?:-[ ]+)?run:[ ]*[|>][+-]?[ ]*\n((?:\1[ ]+[^\n]*\n?|\s*\n)+)"), F.lit(2))).alias("script"))
    return single.unionByName(block)

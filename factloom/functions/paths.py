"""Repository paths: ancestors, classes of files, safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File and directory names that tools give a meaning.
LOCKFILES = ("package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb", "poetry.lock", "uv.lock", "Pipfile.lock", "pdm.lock", "Cargo.lock", "go.sum")
MANIFESTS = {
    "package.json": "javascript-typescript", "deno.json": "javascript-typescript", "deno.jsonc": "javascript-typescript",
    "pyproject.toml": "python", "setup.cfg": "python", "setup.py": "python", "requirements.txt": "python", "Pipfile": "python",
    "Cargo.toml": "rust", "go.mod": "go", "go.work": "go",
}
LOCKFILE_MANAGERS = {
    "package-lock.json": ("javascript-typescript", "npm"), "npm-shrinkwrap.json": ("javascript-typescript", "npm"), "pnpm-lock.yaml": ("javascript-typescript", "pnpm"),
    "yarn.lock": ("javascript-typescript", "yarn"), "bun.lock": ("javascript-typescript", "bun"), "bun.lockb": ("javascript-typescript", "bun"),
    "poetry.lock": ("python", "poetry"), "pdm.lock": ("python", "pdm"), "uv.lock": ("python", "uv"), "Pipfile.lock": ("python", "pipenv"),
    "Cargo.lock": ("rust", "cargo"), "go.sum": ("go", "go-modules"),
}
DIFF_MANIFESTS = {k: v for k, v in MANIFESTS.items() if k not in ("deno.json", "deno.jsonc", "go.work")}
EXCLUDED_DIRECTORIES = (
    ".git", ".hg", ".svn", "node_modules", "bower_components", "jspm_packages", ".pnpm-store", ".yarn", "dist", "build", "out", "coverage", ".next", ".nuxt", ".svelte-kit", ".turbo", ".parcel-cache",
    "__pycache__", ".venv", "venv", ".tox", ".nox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "site-packages", "target", ".gradle", "vendor", "third_party", "Pods",
)
GENERATED_SUFFIXES = (".min.js", ".min.mjs", ".min.cjs", ".min.css", ".map")
NON_SHIPPED_DIRECTORIES = ("test", "tests", "__tests__", "__mocks__", "spec", "specs", "e2e", "cypress", "playwright", "fixtures", "benchmark", "benchmarks", "bench", "scripts", ".storybook", "stories")
NON_SHIPPED_FILES = (
    r"\.(test|spec|e2e|bench|stories)\.[cm]?[jt]sx?$", r"(^|/)[^/]+\.config\.[cm]?[jt]s$", r"(^|/)\.[^/]+rc\.[cm]?[jt]s$",
    r"(^|/)(conftest|noxfile)\.py$", r"(^|/)test_[^/]+\.py$", r"(^|/)[^/]+_test\.py$",
)
VENDORED = r"(^|/)(node_modules|vendor|\.venv|venv|site-packages|target)/"
REQUIREMENTS = r"(?i)(^|/)(?:[\w.-]*[-_.])?requirements(?:[-_.][\w.-]*)?\.(?:txt|in)$"
REQUIREMENTS_DIRECTORY = r"(^|/)requirements/[\w.-]+\.(txt|in)$"


def literal(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """The path without its last segment; '.' for a file at the root."""
    cut = F.regexp_replace(path, "/?[^/]*$", "")
    return F.when(cut == "", ".").otherwise(cut)


def ancestors(directory_path: Column, root: str = ".", strict: bool = False) -> Column:
    """The directory and all above it, nearest first, ending with the root; with strict
    the directory itself is left out."""
    parts = F.split(directory_path, "/")
    depth = F.size(parts)
    chain = F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    chain = F.when(directory_path == root, F.array().cast("array<string>")).otherwise(F.reverse(chain))
    full = F.concat(chain, F.array(F.lit(root)))
    return F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0))) if strict else full


def resolved(folder: Column, relative: Column, root: str = ".") -> Column:
    """``relative`` (or, with a leading slash, from the root) seen from ``folder``, without
    '.' and '..'; the root is '.'; null if it leaves the repository."""
    from_folder = F.when((folder == root) | F.startswith(relative, F.lit("/")), relative).otherwise(F.concat(folder, F.lit("/"), relative))

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1))
        return F.when(done.isNull() | part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(from_folder, "/"), F.array().cast("array<string>"), step)
    return F.when(F.size(parts) == 0, root).otherwise(F.array_join(parts, "/"))


def depth(path: Column, root: str = ".") -> Column:
    return F.when(path == root, 0).otherwise(F.size(F.split(path, "/")))


def is_within(path: Column, project: Column) -> Column:
    return (project == ".") | (path == project) | F.startswith(path, F.concat(project, F.lit("/")))


def is_lockfile(path: Column) -> Column:
    return file_name(path).isin(*LOCKFILES)


def has_excluded_segment(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), literal(EXCLUDED_DIRECTORIES))


def is_generated(path: Column) -> Column:
    out = F.lit(False)
    for suffix in GENERATED_SUFFIXES:
        out = out | F.endswith(path, F.lit(suffix))
    return out


def is_non_shipped(path: Column) -> Column:
    """Test, benchmark, configuration and script code; all else counts as shipped."""
    folders = F.split(path, "/")
    out = F.arrays_overlap(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - 1, F.lit(0))), literal(NON_SHIPPED_DIRECTORIES))
    for pattern in NON_SHIPPED_FILES:
        out = out | path.rlike(pattern)
    return out


def is_safe(path: Column) -> Column:
    """No control character, backslash, absolute or drive path, or '..'; at most 4096."""
    bad = path.rlike(r"[\x00-\x1f\x7f\\]") | path.rlike(r"^(/|[A-Za-z]:)") | path.rlike(r"(^|/)\.\.(/|$)")
    return (F.length(path) > 0) & (F.length(path) <= 4096) & ~bad


def dependency_file(path: Column) -> Column:
    """struct(ecosystem, role, manager) of manifests and lockfiles, else null."""
    kind = "struct<ecosystem:string,role:string,manager:string>"
    name = file_name(path)
    out = F.lit(None).cast(kind)
    requirements = path.rlike(REQUIREMENTS) | path.rlike(REQUIREMENTS_DIRECTORY)
    named = lambda e, r, m: F.struct(F.lit(e).alias("ecosystem"), F.lit(r).alias("role"), F.lit(m).cast("string").alias("manager"))
    out = F.when(requirements, named("python", "manifest", None)).otherwise(out)
    for file, ecosystem in DIFF_MANIFESTS.items():
        out = F.when(name == file, named(ecosystem, "manifest", None)).otherwise(out)
    for file, (ecosystem, manager) in LOCKFILE_MANAGERS.items():
        out = F.when(name == file, named(ecosystem, "lockfile", manager)).otherwise(out)
    return F.when(path.rlike(VENDORED), F.lit(None).cast(kind)).otherwise(out)

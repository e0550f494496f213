"""Package names, specifiers and registries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PUBLIC_REGISTRIES = ("https://registry.npmjs.org", "https://registry.yarnpkg.com")
NODE_BUILTINS = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net", "os", "path",
    "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)


def python_name(name: Column) -> Column:
    """Lower case, with runs of -, _ and . as one dash."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def catalogue_name(ecosystem: Column, name: Column) -> Column:
    return F.when(ecosystem == "python", python_name(name)).otherwise(name)


def types_target(name: Column) -> Column:
    """The package that a declaration package describes: @types/x is x, @types/a__b is @a/b."""
    bare = F.regexp_extract(name, r"^@types/(.+)$", 1)
    scoped = F.regexp_replace(bare, r"^([^/]+?)__([^/]+)$", "@$1/$2")
    return F.when(bare != "", scoped)


# What a specifier's scheme says, and the hosts of repositories.
SCHEMES = {"workspace": "workspace", "link": "link", "file": "file", "git": "git", "github": "git", "gitlab": "git", "bitbucket": "git", "gist": "git"}
REPOSITORY_HOSTS = ("github.com", "gitlab.com", "bitbucket.org")


def specifier_type(raw: Column) -> Column:
    """registry, git, file, link or workspace of a version specifier.

    Its scheme decides if it is one of ``SCHEMES`` or goes over git; a web or ssh address
    is git if it leads to a repository of a known host; without a scheme, paths are files,
    and owner/name and user@host:path are git.  All else is asked of the registry.
    """
    scheme = F.regexp_extract(raw, "^([A-Za-z][A-Za-z0-9+.-]+):", 1)
    said = F.coalesce(*[F.when(scheme == k, v) for k, v in SCHEMES.items()], F.when(scheme.startswith("git+"), "git"))
    place, fragment = F.substring_index(raw, "#", 1), F.regexp_extract(raw, "#(?s:(.*))$", 1)
    after = F.regexp_extract(place, "^[a-z]+://(.+)$", 1)
    host = F.regexp_extract(after, "^(?:[^@/]+@)?([^/:]+)[/:]", 1)
    segments = F.split(F.regexp_replace(after, r"\.git$", ""), "/")
    whole = (F.size(segments) == 3) & F.forall(segments, lambda s: s != "")
    web = scheme.isin("http", "https") & F.regexp_replace(segments[0], r"^www\.", "").isin(*REPOSITORY_HOSTS) & whole
    shell = (scheme == "ssh") & host.isin(*REPOSITORY_HOSTS)
    path = F.substring(raw, 1, 1).isin(".", "/") | raw.startswith("~/") | raw.rlike(r"^[A-Za-z]:[/\\]")
    owned = F.split(place, "/")
    short = (F.size(owned) == 2) & F.forall(owned, lambda s: s.rlike(r"^\w[\w.-]*$")) & ((fragment.startswith("semver:") & ~fragment.rlike(r"[\r\n]")) | ~fragment.rlike(r"\s"))
    copied = F.substring_index(raw, ":", 1).rlike(r"^[^@\s/]+@[\w-]+(\.[\w-]+)+$") & raw.rlike("@[^:]+:.")
    return F.coalesce(said, F.when(path, "file"), F.when(web | shell | short | copied, "git"), F.lit("registry"))


def module_kind(specifier: Column) -> Column:
    """package, builtin, relative, subpath-import, url or invalid of a module specifier."""
    bare = F.regexp_replace(specifier, "^node:", "")
    builtin = F.split(bare, "/")[0].isin(*NODE_BUILTINS)
    return (
        F.when(F.coalesce(F.trim(specifier), F.lit("")) == "", "invalid")
        .when(specifier.rlike(r"^(\.\.?(/|$)|/)"), "relative")
        .when(specifier.startswith("#"), "subpath-import")
        .when(specifier.startswith("node:"), "builtin")
        .when(specifier.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "url")
        .when(builtin, "builtin")
        .when(specifier.rlike(r"^(@[^/\s@]+/)?[A-Za-z0-9._~-][^/\s@]*(/\S*)?$") & ~specifier.rlike(r"^@[^/]*$"), "package")
        .otherwise("invalid")
    )


def module_package(specifier: Column) -> Column:
    """name or @scope/name of a package specifier."""
    return F.when(module_kind(specifier) == "package", F.regexp_extract(specifier, r"^((?:@[^/]+/)?[^/]+)", 1))


def name_of_key(key: Column) -> Column:
    """name of name@version, /name@version or @scope/name@version."""
    return F.regexp_extract(key, r"^/?(@?[^@]+)@(.*)$", 1)


def version_of_key(key: Column) -> Column:
    return F.regexp_extract(key, r"^/?(@?[^@]+)@(.*)$", 2)


def name_in_modules(path: Column) -> Column:
    """What follows the last node_modules/ of an install path."""
    return F.substring_index(path, "node_modules/", -1)


def enclosing_package(path: Column) -> Column:
    """The install path that holds the last node_modules/, '' at the root."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*?)/?node_modules/[^/]+(?:/[^/]+)?$", 1), "/$", "")


def registry_origin(url: Column) -> Column:
    """scheme://host in lower case of a plain http(s) URL without credentials, else null."""
    origin = F.lower(F.regexp_extract(url, r"^(https?://[^/?#@\s]+)", 1))
    plain = url.rlike(r"^https?://[A-Za-z0-9.-]+(:[0-9]+)?([/?#]|$)")
    return F.when(plain, origin)


def is_public_registry(origin: Column) -> Column:
    return F.coalesce(origin.isin(*PUBLIC_REGISTRIES), F.lit(False))


def top_module(path: Column) -> Column:
    return F.substring_index(path, ".", 1)


def go_package_name(path: Column) -> Column:
    """The name that an import path most likely has: its last segment that is no version,
    without a leading go- or trailing .go or -go."""
    plain = F.regexp_replace(path, r"(/v[0-9]+|\.v[0-9]+)$", "")
    last = F.element_at(F.split(plain, "/"), -1)
    return F.regexp_replace(last, r"^go-|[.-]go$", "")

"""Python environment markers and version floors, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.values import once

# What a marker may name, old spellings included.
VARIABLES = (
    "python_version", "python_full_version", "os_name", "sys_platform", "platform_release", "platform_system", "platform_version", "platform_machine", "platform_python_implementation", "implementation_name", "implementation_version", "extra",
    "os.name", "sys.platform", "platform.version", "platform.machine", "platform.python_implementation", "python_implementation",
)
TOKENS = r"""'[^'\n\r]*'|"[^"\n\r]*"|===|==|!=|<=|>=|~=|<|>|[()]|not\s+in(?![A-Za-z0-9_.])|[A-Za-z_][A-Za-z0-9_.]*"""
# What ends a word of a marker: the next character belongs to no name.
_END = r"(?![A-Za-z0-9_.])"
_VALUE = r"""(?:'[^'\n\r]*'|"[^"\n\r]*"|(?:%s)%s)""" % ("|".join(v.replace(".", r"\.") for v in VARIABLES), _END)  # noqa: UP031
_COMPARISON = rf"{_VALUE}\s*(?:===|==|!=|<=|>=|~=|<|>|(?:not\s+)?in{_END})\s*{_VALUE}"
#: Comparisons joined without parentheses, which is what nearly all markers are.
PLAIN = rf"^\s*{_COMPARISON}(?:\s*(?:and|or){_END}\s*{_COMPARISON})*+\s*\z"
#: Parentheses within each other, beyond which a marker counts as wrong.
DEPTH = 64


def is_marker(text: Column) -> Column:
    """Whether a text is an environment marker by its syntax.

    Each token becomes a letter: v for a variable or string, o for a comparison, c for and
    or or, x for anything else.  A comparison is vov, which becomes e; so do comparisons
    that are joined, and what stands in parentheses.  A marker is what ends as one e.  One
    without parentheses is known by one pattern, at a tenth of the cost.
    """
    token = lambda t: (
        F.when(t.rlike("^['\"]") | t.isin(*VARIABLES), "v").when(t.rlike(r"^[=!<>~]|^in$|^not\s+in$"), "o").when(t.isin("and", "or"), "c").when(t.isin("(", ")"), t).otherwise("x")
    )
    letters = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), token), "")
    joined = lambda s: F.regexp_replace(s, "e(?:ce)+", "e")
    # A round opens the innermost parentheses, so there are no more rounds than those.
    rounds = lambda s: F.least(F.length(s) - F.length(F.replace(s, F.lit("("), F.lit(""))), F.lit(DEPTH))
    opened = lambda s: F.aggregate(F.sequence(F.lit(1), rounds(s)), s, lambda x, _: joined(F.regexp_replace(x, r"\(e\)", "e")))
    folded = once(joined(F.regexp_replace(letters, "vov", "e")), lambda s: F.when(s.contains("("), opened(s)).otherwise(s))
    rest = F.regexp_replace(text, TOKENS, "")
    # Letters run on where a v or an o is left over, so vov is never found across tokens.
    return F.when(text.rlike(PLAIN), True).otherwise(F.coalesce((F.trim(F.regexp_replace(rest, r"\s+", "")) == "") & (folded == "e"), F.lit(False)))


def merged(markers: Column) -> Column:
    """The marker of a requirement that is declared with each of an array of markers: none
    if any declaration has none, else all different ones joined by or."""
    joined = lambda d: F.aggregate(F.slice(d, F.lit(2), F.greatest(F.size(d) - 1, F.lit(0))), d[0], lambda a, b: F.concat(F.lit("("), a, F.lit(") or ("), b, F.lit(")")))
    return F.when((F.size(markers) > 0) & ~F.exists(markers, lambda m: m.isNull()), once(F.array_distinct(markers), joined))


BOUND = r"^(>=|>|<=|<|==|!=|~=|\^|~)?\s*(\d{1,9}(?:\.\d{1,9}){0,2})(\.\*)?$"


def floor(constraint: Column) -> Column:
    """struct(version array<int>, exclusive): the least Python that a constraint admits, or
    null if it has none, admits none, or is not understood.

    Each clause is an interval of versions of three numbers; clauses joined by commas are
    intersected, and of alternatives (||) the lowest floor counts.  A floor that a ``!=``
    takes out is no floor.
    """
    arms = F.split(constraint, r"\s*\|\|\s*")
    fine = ~F.regexp_replace(constraint, r"\|\|", "").contains("|") & (F.length(constraint) <= 4096)
    return F.when(fine, once(F.transform(arms, _arm), lambda floors: F.when(~F.exists(floors, lambda f: f.isNull()), F.array_min(floors))))


def _arm(arm: Column) -> Column:
    terms = F.transform(F.split(arm, r"\s*,\s*|\s+(?=[<>!=~^]|\d)"), lambda t: F.trim(t))
    part = lambda t, i: F.regexp_extract(t, BOUND, i)

    def clause(t: Column) -> Column:
        given = F.transform(F.split(part(t, 2), r"\."), lambda x: x.cast("int"))
        return F.when(t.rlike(BOUND), once(F.struct(part(t, 1).alias("sign"), given.alias("given"), (part(t, 3) != "").alias("any_last")), _clause))

    return once(F.transform(terms, clause), _admitted)


def _clause(p: Column) -> Column:
    """struct(low, high, out) of a clause's sign and numbers; null if not understood."""
    sign, given, any_last = p["sign"], p["given"], p["any_last"]
    n, version = F.size(given), _three(given)
    first = F.array_position(F.transform(given, lambda x: x != 0), True).cast("int")
    # The number that the upper bound raises: the last given, the first that is not 0, ...
    raised = F.when(sign == "==", n).when(sign == "^", F.when(first > 0, first).otherwise(n)).when(sign == "~", F.least(n, F.lit(2))).when(sign == "~=", n - 1)
    over = once(raised, lambda at: _three(F.transform(F.slice(given, F.lit(1), at), lambda x, i: x + F.when(i == at - 1, 1).otherwise(0))))
    exact = (sign == "==") & ~any_last
    understood = (~any_last | (sign == "==")) & ~(exact & (n == 1)) & ~((sign == "~=") & (n < 2))
    low = F.when(sign.isin("<", "<=", "!="), F.lit(None)).otherwise(F.struct(version.alias("version"), (sign == ">").alias("exclusive")))
    high = F.when(sign == "<", F.struct(version.alias("v"), F.lit(False).alias("closed"))).when((sign == "<=") | exact, F.struct(version.alias("v"), F.lit(True).alias("closed")))
    high = high.when(sign.isin("==", "^", "~", "~="), F.struct(over.alias("v"), F.lit(False).alias("closed")))
    return F.when(understood, F.struct(low.alias("low"), high.alias("high"), F.when(sign == "!=", version).alias("out")))


def _admitted(clauses: Column) -> Column:
    """The floor of the clauses' intersection; null if it is empty or takes its floor out."""
    bounds = F.struct(F.array_max(F.transform(clauses, lambda c: c["low"])).alias("low"), F.array_min(F.transform(clauses, lambda c: c["high"])).alias("high"))

    def floor_of(b: Column) -> Column:
        low, high = b["low"], b["high"]
        empty = F.coalesce((low["version"] > high["v"]) | ((low["version"] == high["v"]) & (low["exclusive"] | ~high["closed"])), F.lit(False))
        outs = F.filter(F.transform(clauses, lambda c: c["out"]), lambda o: o.isNotNull())
        taken = ~low["exclusive"] & F.exists(outs, lambda o: o == low["version"])
        return F.when(~empty & ~taken, low)

    return F.when(~F.exists(clauses, lambda c: c.isNull()), once(bounds, floor_of))


def _three(numbers: Column) -> Column:
    return F.slice(F.concat(numbers, F.array(F.lit(0), F.lit(0), F.lit(0))), 1, 3)



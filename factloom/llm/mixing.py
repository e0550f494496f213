"""Operator 4: mixing sources to target weights, by soft membership.  DataFrame functions
only: no Python runs in the tasks.

1. A naive Bayes classifier over binned text measures (letter case, symbols, repeated
   words, word length, size, and words that mark a domain) is counted from the labelled
   table, and gives each document a posterior probability for every domain.
2. A document's rate is how often it is to be taken.  The rates minimise the squares of the
   expected domain totals' errors, sum(rate * tokens * posterior) less the target, each as
   a share of its own target, with a slight pull to 1, under rate >= 0.
3. They are found by projected gradient in its lazy form: the steps of all rounds add up to
   one number for each domain, and a document's rate is 1 less their mean under its
   posterior, projected to 0 and above.  A round is one aggregation over all documents,
   which gives the gradient and, to scale the step, the curvature over the documents whose
   rate is not 0.  Steps are halved until they descend; the rounds end at the optimum.
4. So no state per document is kept, and rates can be computed beside the rows themselves,
   without joining them.  Where targets cannot all be met, what is achieved and the
   residuals are of the least squares, and are given on every row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import stored, table

DOMAINS = ("clean", "low", "toxic")
#: Shares of the expected tokens wanted of each domain.
TARGETS = {"clean": 0.94, "low": 0.05, "toxic": 0.01}
#: Labelled rows at most from which the marks are chosen; all labelled rows are counted for
#: everything else.  Marks at most, and the letters of those that are beginnings of words.
WORD_ROWS = 8_000
MARKS = 64
STEMS = (4, 5, 6, 7)
#: Pull of rates to 1, the error (as a share of a target) that ends the rounds, and the share
#: of all tokens that an error is measured by where a target is 0.
PULL = 1e-3
TOLERANCE = 1e-7
NO_TARGET = 0.1
#: How far the anchor's rate is to lie above 1.
HEADROOM = 1.1

#: Documents that each domain counts beside its own.
SMOOTHING = 2.0

#: Upper borders of each measure's bins.
BINS = {
    "upper": (0.01, 0.03, 0.06, 0.15, 0.4),
    "symbols": (0.0005, 0.005, 0.02, 0.05, 0.12),
    "repeats": (0.002, 0.01, 0.03, 0.1, 0.3),
    "word_length": (3.5, 4.5, 5.5, 6.5, 8.0),
    "size": (20, 100, 300, 1000, 4000),
    "marks": (0.5, 1.5, 3.5),
}


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from labels: toxic, else low quality, else clean.  Of repeated
    labels of a doc_id the worst counts; rows without doc_id or any label teach nothing."""
    by = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.coalesce("quality", "toxic").isNotNull(), "clean")
    return by.select("doc_id", domain.alias("domain")).where("domain is not null")


def marks_of(docs: DataFrame, domains: DataFrame, rows: int = WORD_ROWS, most: int = MARKS) -> list[str]:
    """What is far more common in toxic documents than in others, from a bounded sample:
    whole words, and beginnings of words, which end in an asterisk."""
    chosen = domains.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by rows
    split = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), lambda w: F.length(w) >= STEMS[0])
    forms = F.flatten(F.transform(split, lambda w: F.array(w, *[F.when(F.length(w) > n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS])))
    toxic = F.col("domain") == "toxic"
    each = sample.select(toxic.alias("t"), F.explode(F.array_distinct(forms)).alias("form")).where("form is not null")
    sizes = chosen.agg(F.count_if(toxic).alias("p"), F.count_if(~toxic).alias("q")).first()
    p, q = sizes["p"], sizes["q"]
    if not p or not q:
        return []
    counts = each.groupBy("form").agg(F.count_if("t").alias("a"), F.count_if(~F.col("t")).alias("b"))
    odds = F.log(((F.col("a") + 0.5) / (p + 1)) / ((F.col("b") + 0.5) / (q + 1)))
    share = (F.col("a") + F.col("b")) / (p + q)
    apart = (F.col("a") / p - F.col("b") / q) / F.sqrt(share * (1 - share) + 1e-6)
    best = counts.where(F.col("a") >= max(3, p // 200)).withColumn("odds", odds).where("odds > 3").orderBy(F.desc(apart), F.length("form"), "form").limit(16 * most)
    marks: list[str] = []
    for r in best.collect():  # 16 times the marks at most
        stem = r["form"].rstrip("*")
        if len(marks) < most and not any(stem.startswith(m.rstrip("*")) or m.startswith(stem) for m in marks):
            marks.append(r["form"])
    return marks


def tokens_of(text: Column) -> Column:
    """Words of a text, runs without ASCII white space, from the runs between them; null
    has none."""
    white = lambda c: c.isin(*" \t\n\v\f\r").cast("int")
    between = F.regexp_count(text, F.lit(r"[ \t-\r]+"))
    words = between + 1 - white(F.substring(text, 1, 1)) - white(F.substring(text, -1, 1))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(words).cast("long")


def _bin(value: Column, borders: tuple) -> Column:
    out = F.lit(len(borders))
    for i in reversed(range(len(borders))):
        out = F.when(value <= borders[i], i).otherwise(out)
    return out.cast("int")


def binned(docs: DataFrame, marks: list[str]) -> DataFrame:
    """``docs`` with _mix_tokens and _mix_bins (array<int>, a bin for each measure).

    In steps, so that each count is made once and used by name: what a pattern finds in a
    whole text costs far more than all that is reckoned from it.
    """
    columns = docs.columns
    text = F.coalesce("text", F.lit(""))
    found = F.lit(0)
    if marks:
        # Most texts hold no mark's beginning anywhere, and are not searched for words.
        lower = F.col("_mix_lower")
        held = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in sorted({w.rstrip("*")[: STEMS[0]] for w in marks})])
        forms = "|".join(w[:-1] if w.endswith("*") else rf"{w}(?!\p{{L}})" for w in marks)
        whole = F.regexp_extract_all(lower, F.lit(rf"(?<!\p{{L}})(?:{forms})"), F.lit(0))
        found = F.when(held, F.size(F.array_distinct(whole))).otherwise(0)
        docs = docs.withColumn("_mix_lower", F.lower(text))
    counts = {
        "_mix_tokens": tokens_of(F.col("text")),
        "_mix_chars": F.length(text),
        "_mix_upper": F.regexp_count(text, F.lit("[A-ZÀ-Þ]")),
        "_mix_symbols": F.regexp_count(text, F.lit("[!#$%&*|<>{}=\\\\^~]")),
        "_mix_repeats": F.regexp_count(text, F.lit(r"(?<=\s)(\S++)\s\1(?=\s)")),
        "_mix_marks": found,
    }
    chars, words = F.greatest("_mix_chars", F.lit(1)), F.greatest("_mix_tokens", F.lit(1))
    measures = {
        "upper": F.col("_mix_upper") / chars,
        "symbols": F.col("_mix_symbols") / chars,
        "repeats": F.col("_mix_repeats") / words,
        "word_length": chars / words,
        "size": words.cast("double"),
        "marks": F.col("_mix_marks").cast("double"),
    }
    reckoned = docs.withColumns(counts).withColumns({f"_mix_m_{k}": measures[k] for k in BINS})
    bins = F.array(*[_bin(F.col(f"_mix_m_{k}"), borders) for k, borders in BINS.items()])
    return reckoned.select(*columns, "_mix_tokens", bins.alias("_mix_bins"))


@dataclass
class Classifier:
    """log_prior[d] and log_share[measure][d][bin]."""

    domains: tuple[str, ...]
    log_prior: list[float]
    log_share: list[list[list[float]]]

    def logs(self, bins: Column) -> list[Column]:
        """Log of prior and shares for each domain, up to a common constant."""
        out = []
        for d in range(len(self.domains)):
            total = F.lit(self.log_prior[d])
            for m, shares in enumerate(self.log_share):
                total = total + F.element_at(F.array(*[F.lit(x) for x in shares[d]]), bins[m] + 1)
            out.append(total)
        return out


def with_posterior(rows: DataFrame, classifier: Classifier, bins: str) -> DataFrame:
    """``rows`` with _posterior, array<double> of the probability of each domain."""
    names = [f"_mix_log_{d}" for d in range(len(classifier.domains))]
    logged = rows.withColumns(dict(zip(names, classifier.logs(F.col(bins)), strict=True)))
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    weighed = logged.withColumn("_mix_top", top).withColumns({n: F.exp(F.col(n) - F.col("_mix_top")) for n in names})
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return weighed.withColumn("_mix_total", total).withColumn("_posterior", F.array(*[F.col(n) / F.col("_mix_total") for n in names])).drop(*names, "_mix_top", "_mix_total")


def trained(bins: DataFrame, domains: DataFrame, names: tuple[str, ...] = DOMAINS) -> Classifier:
    """Counts of every labelled document; ``bins`` has doc_id and _bins.  Each domain counts
    ``SMOOTHING`` documents more, which lie as those of all domains do, so a domain of few
    documents says little and no bin is impossible.  A domain without documents is, unless
    there are none at all."""
    known = bins.select("doc_id", "_bins").join(domains, "doc_id")
    counts = known.select("domain", F.posexplode("_bins").alias("m", "b")).groupBy("domain", "m", "b").count().collect()  # domains x measures x bins
    table_of = {(r["domain"], r["m"], r["b"]): r["count"] for r in counts}
    sizes = [sum(n for (d, m, _), n in table_of.items() if d == name and m == 0) for name in names]
    everything = sum(sizes)
    log_prior = [math.log(n / everything) if n else -1e4 if everything else 0.0 for n in sizes]
    log_share = []
    for m, borders in enumerate(BINS.values()):
        k = len(borders) + 1
        pooled = [(sum(table_of.get((name, m, b), 0) for name in names) + 0.5) / (everything + 0.5 * k) for b in range(k)]
        log_share.append([[math.log((table_of.get((name, m, b), 0) + SMOOTHING * pooled[b]) / (sizes[d] + SMOOTHING)) for b in range(k)] for d, name in enumerate(names)])
    return Classifier(names, log_prior, log_share)


def rate(posterior: Column, steps: list[float]) -> Column:
    """The rate after all rounds, whose steps add up to these: one number a domain."""
    return F.greatest(F.lit(0.0), 1 - sum((F.lit(float(s)) * posterior[k] for k, s in enumerate(steps)), F.lit(0.0)))


@dataclass
class Fit:
    """The steps' sums, and tokens of each domain: those wanted and those achieved."""

    steps: list[float]
    want: dict[str, float]
    got: dict[str, float]

    def residual(self, domain: str) -> float | None:
        """Error as a share of the target; None where the target is 0."""
        return self.got[domain] / self.want[domain] - 1 if self.want[domain] else None


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Of a small positive definite system."""
    n = len(right)
    rows = [[*m, r] for m, r in zip(matrix, right, strict=True)]
    for i in range(n):
        for j in range(i + 1, n):
            f = rows[j][i] / rows[i][i]
            rows[j] = [a - f * b for a, b in zip(rows[j], rows[i], strict=True)]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (rows[i][n] - sum(rows[i][j] * out[j] for j in range(i + 1, n))) / rows[i][i]
    return out


def fitted_rates(members: DataFrame, targets: dict[str, float], domains: tuple[str, ...] = DOMAINS, anchor: str | None = None) -> Fit:
    """The fit for ``members`` (_tokens, _posterior).

    The targets add up to as many tokens as there are; with an anchor, to as many as leave
    that domain's rate a little above 1.  Rows are then thinned, which brings no domain more
    tokens, so the target of another domain that has fewer is what it has: else rows that
    may just be of that domain would take the place of the anchor's.
    """
    k = range(len(domains))
    pairs = [(i, j) for i in k for j in k if i <= j]
    q = [F.col("_posterior")[i] for i in k]

    def measured(steps: list[float]) -> tuple[list[float], list[list[float]], float]:
        """Totals, curvature and half the squared rates, in tokens."""
        rated = members.withColumn("_rate", rate(F.col("_posterior"), steps))
        weight = F.col("_rate") * F.col("_tokens")
        free = F.when(F.col("_rate") > 0, F.col("_tokens")).otherwise(0)
        row = rated.agg(*[F.sum(weight * x) for x in q], *[F.sum(free * q[i] * q[j]) for i, j in pairs], F.sum(weight * F.col("_rate"))).first()
        found = [float(x or 0.0) for x in row]
        both = dict(zip(pairs, found[len(domains) :], strict=False))
        return found[: len(domains)], [[both[min(i, j), max(i, j)] for j in k] for i in k], found[-1] / 2

    steps = [0.0 for _ in k]
    totals, curvature, half = measured(steps)
    everything = sum(totals)
    weight = sum(targets.get(d, 0.0) for d in domains) or 1.0
    total = everything
    if anchor is not None and targets.get(anchor):
        total = HEADROOM * totals[domains.index(anchor)] * weight / targets[anchor]
    want = [total * targets.get(d, 0.0) / weight for d in domains]
    if anchor is not None:
        want = [w if d == anchor else min(w, t) for d, w, t in zip(domains, want, totals, strict=True)]
    if everything and total:
        scale = [w or NO_TARGET * total for w in want]
        pull = [PULL * s * s / everything for s in scale]
        value = lambda half, steps: half + sum(s * w + p * s * s / 2 for s, w, p in zip(steps, want, pull, strict=True))
        now = value(half, steps)
        while True:
            gradient = [t - w - p * s for t, w, p, s in zip(totals, want, pull, steps, strict=True)]
            if max(abs(g) / s for g, s in zip(gradient, scale, strict=True)) < TOLERANCE:
                break
            move = _solved([[curvature[i][j] + (pull[i] + 1e-12 * everything if i == j else 0.0) for j in k] for i in k], gradient)
            slope, length = sum(g * m for g, m in zip(gradient, move, strict=True)), 1.0
            while length > 1e-9:
                ahead = [s + length * m for s, m in zip(steps, move, strict=True)]
                totals_, curvature_, half = measured(ahead)
                if value(half, ahead) <= now - 1e-4 * length * slope:
                    break
                length /= 2
            else:
                break  # no step descends by more than rounding
            steps, totals, curvature, now = ahead, totals_, curvature_, value(half, ahead)
    return Fit(steps, dict(zip(domains, want, strict=True)), dict(zip(domains, totals, strict=True)))


def learned(docs: DataFrame, labels: DataFrame, targets: dict[str, float], anchor: str | None = None):
    """(marks, classifier, members, fit) for all of docs."""
    domains = stored(domains_of(labels), "domains")
    marks = marks_of(docs, domains)
    bins = stored(binned(docs.select("doc_id", "text"), marks).select("doc_id", F.col("_mix_tokens").alias("_tokens"), F.col("_mix_bins").alias("_bins")), "bins")
    classifier = trained(bins, domains)
    # A posterior is decided by the bins, so the rounds run over the different bins with the
    # tokens of all their documents: at most one row for each cell of the grid.
    cells = stored(with_posterior(bins.groupBy("_bins").agg(F.sum("_tokens").alias("_tokens")), classifier, "_bins"), "cells")
    return marks, classifier, with_posterior(bins, classifier, "_bins"), fitted_rates(cells, targets, anchor=anchor)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, tokens, p_<domain>, rate, and on every row target_<domain> and
    achieved_<domain> (tokens) and residual_<domain> (the error as a share of the target,
    null for a target of 0).

    Every row of ``docs`` has a row; null and empty texts have no tokens, very long ones
    count whole, repeated rows count each.  Without labels all domains are as likely; then,
    and wherever targets cannot be met together, the residuals are those of the least
    squares.  An empty table gives no row.
    """
    _, classifier, members, fit = learned(docs, labels, targets or TARGETS)
    shares = [F.col("_posterior")[k].alias(f"p_{d}") for k, d in enumerate(classifier.domains)]
    sums = [F.lit(v).cast("double").alias(f"{name}_{d}") for name, of in (("target", fit.want.get), ("achieved", fit.got.get), ("residual", fit.residual)) for d, v in ((d, of(d)) for d in classifier.domains)]
    return members.select("doc_id", F.col("_tokens").alias("tokens"), *shares, rate(F.col("_posterior"), fit.steps).alias("rate"), *sums)


def resampled(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, seed: int = 11) -> DataFrame:
    """``docs`` thinned to the targets: a row stays if a hash of its doc_id and text, as a
    number below 1, is less than its rate.  The anchor is the clean domain, so what is
    surely clean has a rate of 1 or more and always stays; nothing is repeated.

    Null and empty texts have no marks and are rated as other texts without any; equal rows
    stay or go together; a text counts whole; an empty table stays empty.
    """
    marks, classifier, _, fit = learned(docs, labels, targets or TARGETS, anchor="clean")
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rated = with_posterior(binned(docs, marks), classifier, "_mix_bins").withColumn("_mix_rate", rate(F.col("_posterior"), fit.steps))
    # A filter is pushed below what it reads, which would repeat each pattern search in every
    # term of the rate; it is not pushed below a row number that it reads too.
    rated = rated.withColumn("_mix_row", F.monotonically_increasing_id())
    return rated.where((F.col("_mix_row") >= 0) & (chance < F.col("_mix_rate"))).select(*docs.columns)


def op4_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

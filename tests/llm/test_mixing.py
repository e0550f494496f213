import os
import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing
from llm_texts import prose

LABELS = "doc_id long, quality int, toxic int"


def corpus(n, seed=1):
    r = random.Random(seed)
    texts, rows = [], []
    for i in range(n):
        words = prose(seed * 10_000 + i, r.randrange(30, 200), 900).split()
        kind = r.choices(["clean", "low", "toxic"], [7, 2, 1])[0]
        if kind == "low":
            words = [w.upper() + "!!" for w in words]
        if kind == "toxic":
            words[::9] = ["vileword"] * len(words[::9])
        texts.append(" ".join(words))
        rows.append((i, int(kind != "low"), int(kind == "toxic")))
    return texts, rows


def totals(rows):
    return {d: sum(r.tokens * r[f"p_{d}"] * r.rate for r in rows) for d in mixing.DOMAINS}


@pytest.mark.parametrize("targets", [None, {"clean": 0.5, "low": 0.3, "toxic": 0.2}, {"clean": 1.0}])
def test_totals_meet_targets(spark, documents, targets):
    texts, labels = corpus(400)
    table = spark.createDataFrame([x for x in labels if x[0] % 2], LABELS)
    rows = mixing.mixed(documents(texts), table, targets).collect()
    assert len(rows) == 400 and all(r.rate >= 0 for r in rows)
    assert all(r.tokens == len(texts[r.doc_id].split()) for r in rows)
    assert all(abs(sum(r[f"p_{d}"] for d in mixing.DOMAINS) - 1) < 1e-9 for r in rows)
    everything = sum(r.tokens for r in rows)
    got = totals(rows)
    for d in mixing.DOMAINS:
        want = rows[0][f"target_{d}"]
        assert abs(got[d] - want) < (0.02 * want or 0.02 * everything), d
        assert rows[0][f"achieved_{d}"] == pytest.approx(got[d])
        assert rows[0][f"residual_{d}"] == (pytest.approx(got[d] / want - 1) if want else None)
    guess = {r.doc_id: max(mixing.DOMAINS, key=lambda d: r[f"p_{d}"]) for r in rows}
    truth = {i: "toxic" if t else "clean" if q else "low" for i, q, t in labels}
    assert sum(guess[i] == truth[i] for i in truth) > 0.95 * len(truth)


def independent_rates(rows, want, pull, sweeps=4000):
    """The same least squares, one rate at a time to its own minimum until nothing moves."""
    everything = sum(t for _, t, _ in rows)
    scale = [w or mixing.NO_TARGET * sum(want) for w in want]
    rates = [1.0] * len(rows)
    totals = [sum(t * q[k] for _, t, q in rows) for k in range(len(want))]
    for _ in range(sweeps):
        moved = 0.0
        for i, (_, t, q) in enumerate(rows):
            slope = sum(t * q[k] * (totals[k] - want[k]) / scale[k] ** 2 for k in range(len(want))) + pull * t / everything * (rates[i] - 1)
            bend = sum((t * q[k] / scale[k]) ** 2 for k in range(len(want))) + pull * t / everything
            new = max(0.0, rates[i] - slope / bend)
            for k in range(len(want)):
                totals[k] += (new - rates[i]) * t * q[k]
            moved, rates[i] = max(moved, abs(new - rates[i])), new
        if moved < 1e-9:
            break
    return rates, totals


@pytest.mark.parametrize(("power", "targets"), [(3, {"clean": 0.2, "low": 0.2, "toxic": 0.6}), (3, {"clean": 0.97, "low": 0.02, "toxic": 0.01}), (0.5, {"clean": 0.9, "low": 0.1})])
def test_rates_are_the_least_squares(spark, power, targets):
    """Against an independent solver, with targets that can and that can't be met."""
    r = random.Random(4)
    rows = []
    for i in range(40):
        q = [r.random() ** power for _ in mixing.DOMAINS]
        rows.append((i, r.randrange(1, 100), [x / sum(q) for x in q]))
    members = spark.createDataFrame(rows, "doc_id long, _tokens long, _posterior array<double>")
    fit = mixing.fitted_rates(members, targets)
    got = [x.rate for x in members.select("doc_id", mixing.rate(F.col("_posterior"), fit.steps).alias("rate")).orderBy("doc_id").collect()]
    rates, totals = independent_rates(rows, list(fit.want.values()), mixing.PULL)
    assert list(fit.got.values()) == pytest.approx(totals, rel=1e-3, abs=1e-3)
    everything, want = sum(n for _, n, _ in rows), list(fit.want.values())

    def cost(rates):
        sums = [sum(x * n * q[k] for x, (_, n, q) in zip(rates, rows, strict=True)) for k in range(len(want))]
        errors = sum(((s - w) / (w or mixing.NO_TARGET * sum(want))) ** 2 for s, w in zip(sums, want, strict=True))
        return errors + mixing.PULL * sum(n * (x - 1) ** 2 for x, (_, n, _) in zip(rates, rows, strict=True)) / everything

    # The other solver creeps along the flat of the cost, and ends above the optimum, but near.
    assert cost(got) <= cost(rates) + 1e-9 and cost(rates) < cost(got) * 1.05
    assert got == pytest.approx(rates, abs=0.3)
    assert min(got) >= 0
    assert fit.got == pytest.approx({d: sum(x * t * q[k] for x, (_, t, q) in zip(got, rows, strict=True)) for k, d in enumerate(mixing.DOMAINS)})


def test_resampling_keeps_clean_texts(spark, documents):
    texts, labels = corpus(400, 2)
    docs = documents(texts)
    kept = mixing.resampled(docs, spark.createDataFrame(labels, LABELS), {"clean": 0.95, "low": 0.03, "toxic": 0.02})
    assert kept.columns == docs.columns
    stay = {r.doc_id for r in kept.collect()}
    by = {k: [i in stay for i, q, t in labels if ("toxic" if t else "clean" if q else "low") == k] for k in mixing.DOMAINS}
    assert sum(by["clean"]) >= 0.99 * len(by["clean"])
    assert sum(by["low"]) < 0.6 * len(by["low"])


def test_thinning_gives_no_clean_text_for_what_is_missing(spark):
    """Toxic tokens are below their target, and only texts that are nearly surely clean have any."""
    kinds = [[0.98, 0.02, 0.0], [0.97, 0.02, 0.01], [0.1, 0.9, 0.0]]
    rows = [(100, q) for q, n in zip(kinds, (60, 40, 10), strict=True) for _ in range(n)]
    fit = mixing.fitted_rates(spark.createDataFrame(rows, "_tokens long, _posterior array<double>"), mixing.TARGETS, anchor="clean")
    sure, nearly, low = (max(0.0, 1 - sum(s * x for s, x in zip(fit.steps, q, strict=True))) for q in kinds)
    assert min(sure, nearly) >= 1 > low
    assert fit.want["toxic"] == pytest.approx(40)


def test_native_plan(spark, documents):
    texts, labels = corpus(30)
    plan = mixing.mixed(documents(texts), spark.createDataFrame(labels, LABELS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_tables(spark, documents, odd_texts):
    empty = spark.createDataFrame([], LABELS)
    rows = mixing.mixed(documents(odd_texts).withColumnRenamed("lang", "rate"), empty).collect()
    assert len(rows) == len(odd_texts)
    odd = spark.createDataFrame([(None, 1, 1), (0, None, None), (1, None, 1), (3, 1, 0), (3, 0, 0), (7, 1, None)], LABELS)
    assert all(r.rate >= 0 for r in mixing.mixed(documents(odd_texts), odd).collect())
    assert mixing.mixed(documents([]), odd).count() == 0
    assert mixing.resampled(documents([]), odd).count() == 0


def test_marks_are_whole_words_in_any_case(spark, documents):
    texts = ["a Badword here", "YOU BADWORD!", "badword, badword: Badword", "a badwordish abadword étébadword", "vile-BADWORD_vile", "Éclat éclats", "ÉCLAT 1badword2", "", None]
    bins = mixing.binned(documents(texts), ["badword", "vile", "éclat"])
    at = list(mixing.BINS).index("marks")
    assert bins.columns == [*documents([]).columns, "_mix_tokens", "_mix_bins"]
    got = {r.doc_id: r._mix_bins[at] for r in bins.collect()}
    assert [got[i] for i in range(len(texts))] == [1, 1, 1, 0, 2, 1, 2, 0, 0]


def test_toxic_documents_in_capitals(spark, documents):
    texts, labels = corpus(400, 5)
    loud = [t.replace("vileword", "VILEWORD") if i % 2 == 0 else t for i, t in enumerate(texts)]
    rows = mixing.mixed(documents(loud), spark.createDataFrame([x for x in labels if x[0] % 2], LABELS)).collect()
    toxic = {i for i, _, t in labels if t}
    assert all((r.p_toxic > 0.5) == (r.doc_id in toxic) for r in rows if r.doc_id % 2 == 0)


def test_totals_meet_targets_on_the_given_tables(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no tables")
    row = mixing.op4_mixing_to_targets(spark, "/root/testdata/sf0.01").first()
    assert all(abs(row[f"residual_{d}"]) < 0.02 for d in mixing.DOMAINS)


def test_beginnings_of_words_are_marks_too(spark, documents):
    texts, labels = corpus(300, 7)
    r = random.Random(1)
    forms = [t.replace("vileword", "gruñz" + r.choice(["al", "emos", "idad", "o"])) for t in texts]
    docs, known = documents(forms), spark.createDataFrame(labels, LABELS)
    marks = mixing.marks_of(docs, mixing.domains_of(known))
    assert marks[0] in ("gruñ*", "gruñz*")
    bins = {x.doc_id: x._mix_bins[list(mixing.BINS).index("marks")] for x in mixing.binned(docs, marks).collect()}
    assert all((bins[i] > 0) == bool(t) for i, _, t in labels)

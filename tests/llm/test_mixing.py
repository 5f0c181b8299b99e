"""Mixing: targets reached or their miss reported, the classifier against plain Python, odd tables and names."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import mixing

MIXES = [{"clean": 0.85, "poor": 0.10, "toxic": 0.05}, {"clean": 0.5, "poor": 0.1, "toxic": 0.4}, {"clean": 0.95, "poor": 0.02, "toxic": 0.03}]


def tables(spark, sf):
    d = f"/root/testdata/{sf}"
    return spark.read.parquet(f"{d}/documents.parquet"), mixing.label_domains(spark.read.parquet(f"{d}/labels.parquet"))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_targets_are_reached_or_their_miss_is_proven(spark, sf):
    """Three mixes with and without a bound on the rates. A miss is proven by steps that go on."""
    docs, labels = tables(spark, sf)
    model = mixing.train_classifier(docs, labels, ["clean", "poor", "toxic"])
    rows = mixing.with_posterior(docs, model).groupBy(F.col("__p").alias("p")).agg(F.sum("__tokens").alias("tokens"))
    rows = rows.sparkSession.createDataFrame(rows.collect(), rows.schema)
    p, t = (np.array(x, float) for x in zip(*[(r.p, r.tokens) for r in rows.collect()]))
    for targets in MIXES:
        for most in (None, 1.0):
            fitted = mixing.fit_rates(rows, model, targets, most=most)
            r = np.ones(len(t))
            for z in fitted.steps:
                r = np.clip(r - p @ np.array(z), 0, most)
            assert np.allclose((p * (t * r)[:, None]).sum(axis=0), fitted.after, rtol=1e-6)
            if fitted.missed > 1e-3:  # ten thousand further steps come hardly nearer
                inverse, wanted = np.linalg.pinv((p * t[:, None]).T @ p), np.array(fitted.targets)
                for _ in range(10_000):
                    r = np.clip(r - p @ (inverse @ ((p * (t * r)[:, None]).sum(axis=0) - wanted)), 0, most)
                gap = np.abs((p * (t * r)[:, None]).sum(axis=0) - wanted).sum() / wanted.sum()
                assert gap > 0.9 * fitted.missed, (sf, targets, most, fitted.missed, gap)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_no_rates_bring_the_pipeline_nearer_to_its_targets(spark, sf):
    """All clean tokens and no toxic ones: the rates reach the least |S - T| there is; a descent of |S - T|**2 drops the same documents, or thins all where nothing tells them apart."""
    import corpus_pipeline as C

    docs, labels = tables(spark, sf)
    rows = mixing.mix(docs, labels, C.TARGETS, most=1.0)[0].select("__tokens", "__p", "__rate").collect()
    t, p, r = (np.array(x, float) for x in zip(*rows))
    wanted = np.array([(t * p[:, 0]).sum(), 0.0])
    totals = lambda rates: (p * (t * rates)[:, None]).sum(axis=0)
    gap = lambda rates: np.abs(totals(rates) - wanted).sum()
    assert gap(r) == pytest.approx((t * p.min(axis=1)).sum(), rel=1e-9)
    inverse, other = np.linalg.pinv((p * t[:, None]).T @ p), np.ones(len(t))
    for _ in range(1_000):
        other = np.clip(other - p @ (inverse @ (totals(other) - wanted)), 0, 1)
    assert gap(r) <= gap(other) * (1 + 1e-9)
    if len(np.unique(p.round(12), axis=0)) == 1:
        assert (r == 1).all() and (other < 0.99).all()
    else:
        assert ((other < 0.5) == (r == 0)).all() and (r == 0).any()


def test_strict_mixes_raise(spark):
    docs, labels = tables(spark, "sf0.001")
    with pytest.raises(mixing.InfeasibleMix):
        mixing.mix(docs, labels, MIXES[0], strict=True)
    assert mixing.mix(docs, labels, MIXES[0])[1].missed > 0.01


def test_classifier_against_plain_python(spark):
    """Counts, indicator words, their ratios, and the posterior of every document, from their definitions."""
    docs, labels = tables(spark, "sf0.01")
    domains = ["clean", "poor", "toxic"]
    model = mixing.train_classifier(docs, labels, domains)
    texts = {r.doc_id: (r.text or "").encode().split() for r in docs.collect()}
    of = {r.doc_id: r.domain for r in labels.collect() if r.doc_id in texts}
    size = Counter(of.values())
    held = defaultdict(Counter)
    for i, d in of.items():
        for w in set(texts[i]):
            held[w][d] += 1
    held = {w: c for w, c in held.items() if sum(c.values()) >= 5}
    sums = {d: max(1, sum(c[d] for c in held.values())) for d in domains}
    every = max(1, sum(sum(c.values()) for c in held.values()))
    assert model.domains == tuple(domains) and np.allclose(model.priors, [math.log(size[d] / size["clean"]) for d in domains])
    for k, d in enumerate(domains[1:]):
        found = []
        for w, c in held.items():
            chance = sum(c.values()) * sums[d] / every
            z, ratio = (c[d] - chance) / math.sqrt(chance + 1), math.log((c[d] + 0.5) / sums[d]) - math.log((c["clean"] + 0.5) / sums["clean"])
            if z >= mixing.DEVIATIONS and ratio >= mixing.LOG_RATIO:
                found.append((-z, w.decode(), round(ratio, 4)))
        assert {w: r for w, r in model.weights[k]} == pytest.approx({w: r for _, w, r in sorted(found)[: mixing.WORDS]}, abs=2e-4)
        none = lambda x: sum(not any(w in {a.encode() for a, _ in model.weights[k]} for w in texts[i]) for i, y in of.items() if y == x)  # noqa: E731,B023
        assert model.absent[k] == pytest.approx(math.log((none(d) + 0.5) / (size[d] + 1) / ((none("clean") + 0.5) / (size["clean"] + 1))))
    for r in mixing.with_posterior(docs, model).collect():
        odds = [0.0]
        for k, weights in enumerate(model.weights):
            hits = [x for w, x in weights if w.encode() in texts[r.doc_id]]
            odds.append(model.priors[k + 1] + (min(sum(hits), mixing.MOST_EVIDENCE) if hits else model.absent[k]))
        e = np.exp(np.array(odds) - max(odds))
        assert r["__tokens"] == len(texts[r.doc_id]) and np.allclose(r["__p"], e / e.sum())


def test_odd_tables_and_names(spark):
    texts = [None, "", "one two three", "one two three", "x" * 300_000, "word " * 100_000, "bad words here " * 3]
    rows = [(k if k != 2 else None, t) for k, t in enumerate(texts)]
    names = ("__e", "__p", "__copies", "__copy", "__rate", "__tokens", "__words", "__p_words", "tokens", "p", "domain", "word")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    some = spark.createDataFrame([(3, "clean"), (6, "toxic"), (6, "clean"), (None, "toxic")], "doc_id long, domain string")
    for targets in MIXES[:1]:
        for frame in (docs, docs.limit(0)):
            out = mixing.mixed(frame, some, targets, most=1.0)
            assert out.columns == docs.columns
            assert all(r[c] == c for r in out.collect() for c in names)
    rated, _ = mixing.mix(docs, some, MIXES[0])
    assert len(rated.columns) == len(docs.columns) + 4 and rated.count() == len(texts)
    again = mixing.mixed(docs, some, {"clean": 1.0, "toxic": 1.0}, total=1e6)
    assert {r["__copies"] for r in again.collect()} <= {"__copies"}

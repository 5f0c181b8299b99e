"""Soft-membership mixing of documents to target domain weights.

A naive Bayes classifier, fitted on a labelled table, gives each document a posterior over domains. Documents
have no hard domain: a document of t tokens adds t * p[d] expected tokens to every domain d. Rates r >= 0
per document are then fitted so that the expected totals S[d] = sum r t p[d] match the targets T:
projected-gradient least squares, min |S - T|**2 in the metric of A = sum t p p', from r = 1. In that metric
the unit step is safe (the scaled operator has norm 1), and without clipping one step ends it. One step
moves a document's rate by the inner product of its posterior with one small vector, then clips, so a
rate is a short expression over the posterior and no rates are stored or shuffled: each round is one sum
over (tokens, posterior), with equal posteriors summed beforehand.

The rounds end when the targets are reached or when projected gradients bring the totals no nearer any more. Where
the size of the corpus is free, it is next let go, and the totals are brought to the ray of the weights; how far the
totals stay from their targets is part of the result (Mixture.missed).

A domain of weight 0 is unwanted: documents that belong to unwanted domains, more likely than not or by full
evidence, have rate 0, and all others are fitted to the other domains' targets alone, so that unwanted tokens, however few, never
lower the rate of wanted ones.

The classifier is a naive Bayes model over indicator words: for each domain but the first, the words that its
documents hold significantly more often than the others', at most WORDS of them, counted over a bounded sample of
labelled rows. Their log ratios are short constants in the plan. Everything is DataFrame operations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, settled

#: Indicator words of a domain at most, and what makes one: by how many standard deviations of chance, and by
#: which log ratio, the domain's documents hold it more often than those of the first domain.
WORDS, DEVIATIONS, LOG_RATIO = 128, 8.0, 1.0
#: Evidence for a domain counts up to these log-odds, so that posteriors stay soft.
MOST_EVIDENCE = 6.0
#: Totals within this share of their targets count as reached; a free total is taken if at least this share of the wished one is.
MISSED, LEAST_TOTAL = 1e-4, 0.1


@dataclass(frozen=True)
class Classifier:
    """Log-odds against the first domain: priors, and for each further domain its indicator words with their log ratios.

    absent has, for each further domain, the log ratio of holding none of its indicator words.
    """

    domains: tuple[str, ...]
    priors: tuple[float, ...]
    weights: tuple[tuple[tuple[str, float], ...], ...]
    absent: tuple[float, ...] = ()


@dataclass(frozen=True)
class Mixture:
    """The fit: domains, targets, totals before and after, and the vectors of the steps."""

    classifier: Classifier
    targets: tuple[float, ...]
    before: tuple[float, ...]
    after: tuple[float, ...]
    steps: tuple[tuple[float, ...], ...]
    most: float | None

    @property
    def missed(self) -> float:
        """How far the totals stay from their targets, as a share of all wanted tokens; 0 where nothing is wanted."""
        wanted = sum(self.targets)
        return sum(abs(a - t) for a, t in zip(self.after, self.targets) if t > 0) / wanted if wanted else 0.0


class InfeasibleMix(ValueError):
    """No rates bring the documents to the targets: no mixture of their posteriors has these weights."""


def words(text: Column) -> Column:
    """The words of a text, as an array; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     "), " "), "")


def train_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000) -> Classifier:
    """A classifier from labelled rows (id, domain); at most about `sample` of them, chosen by a hash of the id, are used.

    A document labelled twice counts as the alphabetically first domain. Domains without a labelled document are left out.
    """
    own = labelled.where(F.col("domain").isin(domains)).groupBy(F.col(id_col).alias("id")).agg(F.min("domain").alias("domain"))
    total = own.count()
    draw = F.pmod(F.xxhash64("id", F.lit("mixing sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = F.broadcast(own.where(draw < min(1.0, sample / max(1, total))))  # bounded by sample
    texts = settled(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id"))
    sizes = {r.domain: r.n for r in texts.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    known = [d for d in domains if sizes.get(d)]
    if not known:
        return Classifier((), (), ())
    held = texts.select("domain", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    held = held.groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(known)], F.count("*").alias("n"))
    held = settled(held.where("n >= 5"))
    sums = held.agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(known))], F.sum("n").alias("n")).first()
    weights = []
    for k in range(1, len(known)):
        mine, base = max(1, sums[f"c{k}"] or 0), max(1, sums["c0"] or 0)
        chance = F.col("n") * (mine / max(1, sums["n"] or 0))
        ratio = F.log((F.col(f"c{k}") + 0.5) / mine) - F.log((F.col("c0") + 0.5) / base)
        telling = held.select("word", ((F.col(f"c{k}") - chance) / F.sqrt(chance + 1)).alias("z"), ratio.alias("ratio"))
        top = telling.where((F.col("z") >= DEVIATIONS) & (F.col("ratio") >= LOG_RATIO)).orderBy(F.desc("z"), "word").limit(WORDS)
        weights.append(tuple((r.word, round(r.ratio, 4)) for r in top.collect()))
    priors = [math.log(sizes[d] / sizes[known[0]]) for d in known]
    none = [F.count_if(F.size(_hits(words(F.col("text")), w)) == 0).alias(f"c{k}") for k, w in enumerate(weights, 1)]
    without = {r.domain: r for r in texts.groupBy("domain").agg(F.count("*").alias("n"), *none).collect()}
    share = lambda d, k: (without[d][f"c{k}"] + 0.5) / (without[d].n + 1)
    absent = [math.log(share(d, k) / share(known[0], k)) for k, d in enumerate(known[1:], 1)]
    return Classifier(tuple(known), tuple(priors), tuple(weights), tuple(absent))


def _hits(own: Column, weights: tuple[tuple[str, float], ...]) -> Column:
    return F.array_intersect(own, F.array(*[F.lit(w) for w, _ in weights]).cast("array<string>"))


def _evidence(own: Column, weights: tuple[tuple[str, float], ...], absent: float) -> Column:
    """The sum of the log ratios of the distinct indicator words among a text's words; `absent` if there are none."""
    if not weights:
        return F.lit(0.0)
    ratios, hits = F.create_map(*[F.lit(x) for pair in weights for x in pair]), _hits(own, weights)
    total = F.aggregate(hits, F.lit(0.0), lambda total, word: total + F.element_at(ratios, word))
    return F.when(F.size(hits) == 0, F.lit(absent)).otherwise(F.least(total, F.lit(MOST_EVIDENCE)))


def with_posterior(docs: DataFrame, model: Classifier, text_col: str = "text", tokens: str = "__tokens", posterior: str = "__p") -> DataFrame:
    """docs with its number of words and the posterior (array of double, in the order of the domains) under these names; map-side only."""
    own, odds, scaled = (free_name(docs, f"{posterior}_{x}") for x in ("words", "odds", "scaled"))
    marked = docs.withColumn(own, words(F.col(text_col)))
    terms = [F.lit(0.0)] + [F.lit(p) + _evidence(F.col(own), w, none) for p, w, none in zip(model.priors[1:], model.weights, model.absent)]
    marked = marked.withColumns({tokens: F.size(own).cast("long"), odds: F.array(*terms)}).drop(own)
    top = F.array_max(odds)
    marked = marked.withColumn(scaled, F.transform(odds, lambda x: F.exp(x - top)))
    whole = F.aggregate(scaled, F.lit(0.0), lambda a, b: a + b)
    return marked.withColumn(posterior, F.transform(scaled, lambda x: x / whole)).drop(odds, scaled)


def rate(posterior: Column, steps: tuple[tuple[float, ...], ...], most: float | None) -> Column:
    """The rate of a document after the steps; never negative, at most `most` if that is given."""
    if not steps:
        return F.lit(1.0)

    def moved(r: Column, step: Column) -> Column:
        to = r - sum((F.element_at(posterior, d + 1) * F.element_at(step, d + 1) for d in range(len(steps[0]))), F.lit(0.0))
        return F.greatest(F.lit(0.0), to if most is None else F.least(F.lit(float(most)), to))

    all_steps = ", ".join(f"array({', '.join(f'{x!r}D' for x in step)})" for step in steps)
    return F.aggregate(F.expr(f"array({all_steps})"), F.lit(1.0), moved)


def shares(targets: dict[str, float], domains: tuple[str, ...]) -> np.ndarray:
    """The weights of the domains, scaled to 1; equal ones where none is wanted."""
    weights = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    return weights / weights.sum() if weights.sum() else np.full(len(domains), 1 / max(1, len(domains)))


def unwanted(posterior: Column, targets: dict[str, float], model: Classifier) -> Column | None:
    """Whether a document belongs to domains of weight 0; None where there is no such domain.

    It does if that is more likely than not, or if its words hold all the evidence that counts (MOST_EVIDENCE), which
    a scarce domain's prior would outweigh. With rates of at most 1 the first rule is the exact fit to all wanted and no
    unwanted tokens: |S - T| is then linear in every rate, so that no steps bring the totals nearer.
    """
    out = [d for d, w in enumerate(shares(targets, model.domains)) if not w]
    if not out:
        return None
    likely = sum((F.element_at(posterior, d + 1) for d in out), F.lit(0.0)) > 0.5
    proven = [F.ln(F.element_at(posterior, d + 1) / F.element_at(posterior, 1)) - model.priors[d] > MOST_EVIDENCE - 1e-6 for d in out if 0 not in out]
    for x in proven:
        likely = likely | x
    return likely


def fit_rates(posteriors: DataFrame, model: Classifier, targets: dict[str, float], total: float | None = None, most: float | None = None, rounds: int = 60, tolerance: float = 1e-6) -> Mixture:
    """The steps whose rates bring the expected totals of rows (tokens, p) to the targets.

    targets are weights; those of unknown domains are left out and the rest scaled to 1. total is the wanted number
    of tokens; if None, the largest one that no domain's own tokens fall short of, so that nothing needs repeating, or,
    where that is out of reach, whatever total the weights are reached at. If the weights are out of reach as well, the
    nearest rates for the first total are the result. Domains of weight 0 take no part in the fit: rows are to come
    without the unwanted ones.
    """
    n = len(model.domains)
    compact = settled(posteriors.groupBy("p").agg(F.sum("tokens").cast("double").alias("tokens")))
    sums = [F.sum(F.col("tokens") * F.element_at("p", d + 1)) for d in range(n)]
    pairs = [(d, e) for d in range(n) for e in range(d, n)]
    metric = [F.sum(F.col("tokens") * F.element_at("p", d + 1) * F.element_at("p", e + 1)) for d, e in pairs]
    row = compact.agg(*[x.alias(f"c{k}") for k, x in enumerate(sums + metric)]).first()
    first = np.array([x or 0.0 for x in row])
    before, a = first[:n], np.zeros((n, n))
    for (d, e), x in zip(pairs, first[n:]):
        a[d, e] = a[e, d] = x
    weights = shares(targets, model.domains)
    asked = weights > 0
    free, inverse = total is None, np.linalg.pinv(a * np.outer(asked, asked))
    if total is None:
        total = min((b / w for b, w in zip(before, weights) if w > 0), default=0.0)
    along = weights @ inverse @ weights

    def descend(total: float | None) -> tuple[list[tuple[float, ...]], np.ndarray, np.ndarray]:
        """Steps, totals reached and targets; without a total the nearest point of the weights' ray is the target."""
        steps, reached, slow = [], before, 0
        for _ in range(rounds):
            wanted = weights * (total if total is not None else weights @ inverse @ reached / along)
            if not wanted.sum() or np.abs(reached - wanted)[asked].sum() <= tolerance * wanted.sum():
                break
            gap = np.abs(reached - wanted)[asked].sum()
            steps.append(tuple(float(x) for x in inverse @ (reached - wanted)))
            rated = compact.select("p", (rate(F.col("p"), tuple(steps), most) * F.col("tokens")).alias("rt"))
            row = rated.agg(*[F.sum(F.col("rt") * F.element_at("p", d + 1)).alias(f"s{d}") for d in range(n)]).first()
            reached = np.array([x or 0.0 for x in row])
            slow = slow + 1 if np.abs(reached - wanted)[asked].sum() > 0.999 * gap else 0
            if slow == 3:
                break  # the projected gradient moves the totals no more
        return steps, reached, weights * (total if total is not None else weights @ inverse @ reached / along)

    steps, reached, wanted = descend(total) if before.sum() else ([], before, weights * total)
    made = Mixture(model, tuple(wanted), tuple(before), tuple(reached), tuple(steps), most)
    if free and made.missed > MISSED and before.sum() and along > 0:
        steps, reached, wanted = descend(None)
        freed = Mixture(model, tuple(wanted), tuple(before), tuple(reached), tuple(steps), most)
        made = freed if freed.missed <= MISSED and sum(freed.targets) >= LEAST_TOTAL * total else made
    return made


def mix_columns(docs: DataFrame) -> dict[str, str]:
    """The names of the columns that mix() adds: these, or longer ones where docs has such columns."""
    return {name: free_name(docs, f"__{name}") for name in ("tokens", "p", "rate", "copies")}


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", total: float | None = None, most: float | None = None, strict: bool = False) -> tuple[DataFrame, Mixture | None]:
    """docs with __tokens, __p, __rate and __copies (or as mix_columns(docs) says) behind their columns, and the fit.

    A document's copies are its rate, rounded up or down by a hash of its id so that their expectation is the rate.
    A null or empty text has no tokens and the prior as posterior; texts of any length are read whole; repeated rows share
    posterior, rate and rounding, and so do rows with a null id; docs may have any further columns. Documents of unwanted domains, those of weight 0, have
    rate 0. Without any labelled document every rate is 1. No rows give no rows. strict: InfeasibleMix is raised where
    the totals stay more than MISSED from their targets.
    """
    at = mix_columns(docs)
    model = train_classifier(docs, labelled, list(targets), id_col, text_col)
    if not model.domains:
        plain = docs.withColumns({at["tokens"]: F.size(words(F.col(text_col))).cast("long"), at["p"]: F.array().cast("array<double>"), at["rate"]: F.lit(1.0), at["copies"]: F.lit(1)})
        return plain, None
    marked = with_posterior(docs, model, text_col, at["tokens"], at["p"])
    # settled, so that the filter on posteriors is not pushed below their computation, which it would repeat
    compact = settled(marked.groupBy(F.col(at["p"]).alias("p")).agg(F.sum(at["tokens"]).alias("tokens")))
    refused = unwanted(F.col("p"), targets, model)
    fitted = fit_rates(compact if refused is None else compact.where(~refused), model, targets, total, most)
    if strict and fitted.missed > MISSED:
        raise InfeasibleMix(f"targets {fitted.targets}, reached {fitted.after}")
    refused, rates = unwanted(F.col(at["p"]), targets, model), rate(F.col(at["p"]), fitted.steps, most)
    rated = marked.withColumn(at["rate"], rates if refused is None else F.when(refused, 0.0).otherwise(rates))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(at["rate"]) + F.when(draw < F.col(at["rate"]) - F.floor(at["rate"]), 1).otherwise(0)
    return rated.withColumn(at["copies"], copies.cast("int")), fitted


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", total: float | None = None, most: float | None = None, strict: bool = False) -> DataFrame:
    """The mixed corpus: docs, each row as often as its copies say."""
    copies = mix_columns(docs)["copies"]
    rated, _ = mix(docs, labelled, targets, id_col, text_col, total, most, strict)
    # The added 0 is formally not deterministic, which keeps the filter on the copies above this projection: pushed
    # below, it would spell out and evaluate the posterior once for each use.
    drawn = rated.withColumn(copies, (F.col(copies) + F.monotonically_increasing_id() % 1).cast("int")).where(F.col(copies) > 0)
    if most is None or most > 1:
        drawn = drawn.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return drawn.select(*docs.columns)


def label_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain) of a table of quality and toxicity labels: toxic before poor before clean; unlabelled rows are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return labels.select(F.col(id_col), domain.alias("domain")).where("domain is not null")

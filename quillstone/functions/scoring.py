"""Scores, classes and formats of response analysis, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The score's weights and thresholds, and the levels of digest distances.
WEIGHTS = {"time": 0.2, "length": 0.2, "simhash": 0.3, "tlsh": 0.2, "status": 0.1}
ANOMALY_SCORE, INTERESTING_SCORE, SIMILARITY_PERCENT = 70.0, 40.0, 80.0
TLSH_LEVELS = ((0, "identical"), (10, "nearly_same"), (30, "very_similar"), (100, "similar"), (200, "somewhat_similar"))


def skew(x: Column, average: Column) -> Column:
    """x over its average; 0, meaning absent, where the average is not positive."""
    return F.when(average > 0, x / average).otherwise(0.0)


def z_score(x: Column, average: Column, deviation: Column) -> Column:
    return F.when(deviation > 0, (x - average) / deviation).otherwise(0.0)


def anomaly_types(time_skew: Column, length_skew: Column, status_known: Column, time_multiple: float, length_multiple: float) -> Column:
    """The anomalies of a response, in order: slow or fast, long or short, unexpected status."""
    found = F.array(
        F.when(time_skew > time_multiple, "slow_response").when((time_skew > 0) & (time_skew < 1.0 / time_multiple), "fast_response"),
        F.when(length_skew > length_multiple, "long_response").when((length_skew > 0) & (length_skew < 1.0 / length_multiple), "short_response"),
        F.when(~status_known, "unexpected_status"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def anomaly_label(types: Column) -> Column:
    """One name for the anomalies: the only one, `multiple_anomalies` or `none`."""
    return F.when(F.size(types) > 1, "multiple_anomalies").when(F.size(types) == 1, F.element_at(types, 1)).otherwise("none")


def multiple_text(m: Column) -> Column:
    """A multiple, cut to one decimal; `10+` from ten on."""
    tenths = F.floor(m * 10)
    return F.when(m >= 10, "10+").otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")))


def anomaly_reason(types: Column, time_skew: Column, length_skew: Column) -> Column:
    """One phrase for each anomaly, joined by `; `."""
    text = lambda what, multiple, how: F.concat(F.lit(f"response {what} "), multiple_text(multiple), F.lit(f"x {how} than baseline"))
    phrase = lambda t: (
        F.when(t == "slow_response", text("time", time_skew, "slower"))
        .when(t == "fast_response", text("time", 1 / time_skew, "faster"))
        .when(t == "long_response", text("length", length_skew, "larger"))
        .when(t == "short_response", text("length", 1 / length_skew, "smaller"))
        .otherwise(F.lit("unexpected status code"))
    )
    return F.array_join(F.transform(types, phrase), "; ")


def composite_score(time_skew: Column, length_skew: Column, status_known: Column, simhash_similarity: Column | None = None, tlsh_similarity: Column | None = None, weights: Mapping[str, float] = WEIGHTS) -> Column:
    """The weighted mean, 0 to 100, of the parts that are present; only slower and longer responses score."""
    part = lambda s: F.least(F.lit(100.0), F.greatest(F.lit(0.0), (s - 1.0) * 50.0))
    parts = [(time_skew > 0, part(time_skew), weights["time"]), (length_skew > 0, part(length_skew), weights["length"])]
    for similarity, name in ((simhash_similarity, "simhash"), (tlsh_similarity, "tlsh")):
        if similarity is not None:
            parts.append((similarity.isNotNull(), F.lit(100.0) - similarity, weights[name]))
    parts.append((~status_known, F.lit(100.0), weights["status"]))
    score = sum((F.when(here, value * w).otherwise(0.0) for here, value, w in parts), F.lit(0.0))
    weight = sum((F.when(here, w).otherwise(0.0) for here, _, w in parts), F.lit(0.0))
    return F.when(weight > 0, score / weight).otherwise(0.0)


def classification(status: Column, score: Column, is_anomaly: Column) -> Column:
    """error, anomaly, interesting or normal; a server error comes before every score."""
    return (
        F.when(status >= 500, "error")
        .when(score >= ANOMALY_SCORE, "anomaly")
        .when(score >= INTERESTING_SCORE, "interesting")
        .when(is_anomaly, "anomaly")
        .otherwise("normal")
    )


def tlsh_similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), (1 - distance / 300.0) * 100.0)


def tlsh_level(distance: Column) -> Column:
    found = F.when(F.lit(False), "")
    for most, name in TLSH_LEVELS:
        found = found.when(distance <= most, name)
    return found.otherwise("different")


def timing_ratio(time: Column, baseline: Column) -> Column:
    """time over baseline, null for a baseline of 0; suspicious from 2.0 on."""
    return F.try_divide(time, baseline)


def length_similarity(a: Column, b: Column) -> Column:
    """The shorter over the longer length; 1 for two empty ones."""
    longer = F.greatest(a, b)
    return F.when(longer == 0, 1.0).otherwise(F.least(a, b) / longer)


def hit_bucket(hits: Column) -> Column:
    """Classes of hit counts: 0, 1, 2, 3, to 7, to 15, to 31, to 127, more, as 0 to 8."""
    found = F.when(hits <= 3, hits)
    for most, bucket in ((7, 4), (15, 5), (31, 6), (127, 7)):
        found = found.when(hits <= most, bucket)
    return found.otherwise(8).cast("int")


def cpu_percent(cpu_delta: Column, system_delta: Column, cpus: Column) -> Column:
    """CPU use in percent, two decimals; 0 unless both deltas are positive."""
    used = (cpu_delta / system_delta) * F.coalesce(cpus, F.lit(1)) * 100.0
    return F.when((cpu_delta > 0) & (system_delta > 0), F.round(used, 2)).otherwise(0.0)


def memory_percent(usage: Column, limit: Column) -> Column:
    return F.when(limit > 0, F.round(usage / limit * 100.0, 2)).otherwise(0.0)

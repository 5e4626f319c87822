"""Explainable scoring: a weighted mean of signal strengths, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.params import IMPACT, STEEPNESS, Fusion


@dataclass(frozen=True)
class Signal:
    """An observed value against its threshold; absent where ``present`` is false."""

    name: str
    value: Column
    threshold: float
    weight: float
    higher_is_worse: bool = True
    present: Column | None = None


def strength(value: Column, threshold: float, higher_is_worse: bool = True, steepness: float = STEEPNESS) -> Column:
    """Logistic of the ratio to the threshold: 0.5 at it; infinite ratios give 1, infinite values of an inverse signal 0."""
    v = value.cast("double")
    if higher_is_worse:
        ratio = v / F.lit(float(threshold))
        return F.when(v == float("inf"), 1.0).otherwise(1 / (1 + F.exp(-steepness * (ratio - 1))))
    ratio = F.try_divide(F.lit(float(threshold)), v)
    return F.when(v <= 0, 1.0).when(v == float("inf"), 0.0).otherwise(1 / (1 + F.exp(-steepness * (ratio - 1))))


def combine(signals: list[Signal]) -> tuple[Column, Column]:
    """(confidence to four places, factors by falling contribution) over the signals that are present."""
    weights, parts, factors = F.lit(0.0), F.lit(0.0), []
    for s in signals:
        here = s.present if s.present is not None else F.lit(True)
        weights = weights + F.when(here, F.lit(s.weight)).otherwise(0.0)
        parts = parts + F.when(here, F.lit(s.weight) * strength(s.value, s.threshold, s.higher_is_worse)).otherwise(0.0)
    for i, s in enumerate(signals):
        here = s.present if s.present is not None else F.lit(True)
        share = F.round(s.weight * strength(s.value, s.threshold, s.higher_is_worse) / weights, 4)
        factors.append(F.when(here, F.struct((-share).alias("order"), F.lit(i).alias("place"), F.lit(s.name).alias("feature"), share.alias("contribution"))))
    ranked = F.array_sort(F.array_compact(F.array(*factors)))
    return F.round(parts / weights, 4), F.transform(ranked, lambda x: F.struct(x["feature"].alias("feature"), x["contribution"].alias("contribution")))


def impact(threat_class: Column) -> Column:
    out = F.lit(1.0)
    for name, value in IMPACT.items():
        out = F.when(threat_class == name, value).otherwise(out)
    return out


def severity_score(confidence: Column, threat_class: Column, criticality: Column, p: Fusion = Fusion()) -> Column:
    weight = p.weight_base + p.weight_step * criticality
    return F.least(F.lit(100), F.bround(100 * confidence * impact(threat_class) * weight, 0).cast("int"))


def severity(score: Column, p: Fusion = Fusion()) -> Column:
    return F.when(score >= p.critical, "critical").when(score >= p.high, "high").when(score >= p.medium, "medium").otherwise("low")


def evidence(items: dict[str, tuple[Column, str | None]], texts: dict[str, tuple[Column, str | None]] | None = None) -> Column:
    """Evidence map: numbers rounded to four places and kept beside their text, then plain texts."""
    pairs = []
    for name, (value, reference) in items.items():
        v = F.round(value.cast("double"), 4)
        pairs += [F.lit(name), F.struct(v.cast("string").alias("observed"), v.alias("observed_num"), (reference if isinstance(reference, Column) else F.lit(reference)).cast("string").alias("reference"))]
    for name, (value, reference) in (texts or {}).items():
        pairs += [F.lit(name), F.struct(value.cast("string").alias("observed"), F.lit(None).cast("double").alias("observed_num"), (reference if isinstance(reference, Column) else F.lit(reference)).cast("string").alias("reference"))]
    return F.create_map(*pairs)

"""Statistics as column expressions, and ordered folds over sorted arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.params import Baseline, Trw


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts, in one pass over it."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("spread"))

    def step(a, n):
        return F.when(n > 0, F.struct((a["sum"] + n).alias("sum"), (a["spread"] + n * F.log2(n)).alias("spread"))).otherwise(a)

    return F.aggregate(counts, start, step, lambda a: F.when(a["sum"] > 0, F.greatest(F.log2(a["sum"]) - a["spread"] / a["sum"], F.lit(0.0))).otherwise(0.0))


def string_entropy(text: Column) -> Column:
    """Entropy in bits of a text's characters; 0 for the empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double"))
    return F.when(F.length(text) > 0, entropy(counts)).otherwise(0.0)


def pcr(out: Column, into: Column) -> Column:
    """Producer-consumer ratio: 1 pure upload, -1 pure download, 0 without bytes."""
    total = out + into
    return F.when(total == 0, 0.0).otherwise((out - into) / total)


def cv(std: Column, mean: Column) -> Column:
    """Coefficient of variation; infinite at a mean of 0."""
    return F.when(mean == 0, float("inf")).otherwise(std / mean)


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def array_std(values: Column) -> Column:
    """Population deviation; 0 below two values."""
    m = array_mean(values)
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return F.when(F.size(values) < 2, 0.0).otherwise(F.sqrt(squares / F.size(values)))


def nearest_rank(values: Column, q: float) -> Column:
    """Element at index int(q n), from 0 and at most n - 1, of the sorted values."""
    s = F.sort_array(values)
    n = F.size(s)
    return F.try_element_at(s, F.least(n, F.floor(n * q).cast("int") + 1))


def fold(values: Column, start: Column, step: Callable, finish: Callable | None = None) -> Column:
    return F.aggregate(values, start, step, finish) if finish else F.aggregate(values, start, step)


def ewma(values: Column, p: Baseline = Baseline()) -> Column:
    """struct(n, mean, var) after folding the values in order; the first one sets the mean."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("var"))

    def step(a, x):
        d = x - a["mean"]
        up = p.alpha * d
        first = a["n"] == 0
        return F.struct(
            (a["n"] + 1).alias("n"),
            F.when(first, x).otherwise(a["mean"] + up).alias("mean"),
            F.when(first, 0.0).otherwise((1 - p.alpha) * (a["var"] + d * up)).alias("var"),
        )

    return F.aggregate(values, start, step)


def zscore(x: Column, base: Column, p: Baseline = Baseline()) -> Column:
    """Deviation from an ewma() struct, whose deviation is floored; null until it has enough samples."""
    spread = F.greatest(F.sqrt(base["var"]), p.std_floor * F.abs(base["mean"]), F.lit(1.0))
    return F.when(base["n"] >= p.ready, (x - base["mean"]) / spread)


def trw(outcomes: Column, p: Trw = Trw()) -> Column:
    """Threshold random walk over booleans (true: success): the log likelihood, reset at its lower bound."""

    def step(a, ok):
        moved = a + F.when(ok, p.on_success).otherwise(p.on_failure)
        return F.when(moved <= p.lower, 0.0).otherwise(moved)

    return F.aggregate(outcomes, F.lit(0.0), step)


def doubling(values: Column, threshold: float) -> Column:
    """The values at which a trigger fires: at the threshold, then at twice what it fired at."""
    start = F.struct(F.lit(float(threshold)).alias("next"), F.array().cast("array<double>").alias("fired"))

    def step(a, v):
        hit = v.cast("double") >= a["next"]
        return F.struct(
            F.when(hit, v.cast("double") * 2).otherwise(a["next"]).alias("next"),
            F.when(hit, F.concat(a["fired"], F.array(v.cast("double")))).otherwise(a["fired"]).alias("fired"),
        )

    return F.aggregate(values, start, step, lambda a: a["fired"])


def anchors(times: Column, size: float) -> Column:
    """Starts of windows anchored at their first event: one opens when a time is more than ``size`` past the last start."""
    none = F.array().cast("array<double>")

    def step(a, t):
        fresh = (F.size(a) == 0) | (t - F.element_at(a, -1) > size)
        return F.when(fresh, F.concat(a, F.array(t))).otherwise(a)

    return F.aggregate(times, none, step)

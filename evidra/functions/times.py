"""Times and numbers as Column expressions. Nothing reads the clock: a query that needs 'now' is given it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_timestamp(c: Column) -> Column:
    """An ISO time with a zone; null for one without, and for anything else."""
    return F.when(c.rlike(r"(?:Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(c))


def epoch_iso(seconds: Column) -> Column:
    """Epoch seconds as ISO text with milliseconds, cut off, in UTC; null beyond the years 1 to 9999."""
    ms = F.floor(seconds * 1000).cast("long")
    fits = seconds.between(-62135596800.0, 253402300799.999)
    return F.when(fits, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def age_hours(then: Column, now: Column) -> Column:
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    return micros / F.lit(3.6e9)


def freshness(hours: Column, half_life: float = 48.0) -> Column:
    """Halves with every half-life; a future time counts as now."""
    return F.exp(F.lit(-math.log(2)) * F.greatest(hours, F.lit(0.0)) / F.lit(half_life))


def backoff_ms(attempt: Column) -> Column:
    return F.least(F.lit(3000) * F.pow(F.lit(2), F.least(attempt, F.lit(3))), F.lit(15000)).cast("long")


def in_unit(c: Column) -> Column:
    """A finite number from 0 to 1; false for null and NaN."""
    return F.coalesce(c.between(0.0, 1.0), F.lit(False))


#: The factors of the relevance score and their weights, in the order they are added.
WEIGHTS = (("relevance", 0.375), ("pain_intensity", 0.1875), ("buying_intent", 0.125), ("replyability", 0.1875), ("product_fit", 0.125))


def weighted_mean(columns: dict[str, Column]) -> Column:
    terms = [F.lit(w) * columns[name] for name, w in WEIGHTS]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def score(columns: dict[str, Column], hours: Column) -> Column:
    """STRUCT<linear, decay, score>, null where a factor is no number from 0 to 1 or the age is missing."""
    valid = hours.isNotNull()
    for name, _ in WEIGHTS:
        valid = valid & in_unit(columns[name])
    linear, decay = weighted_mean(columns), freshness(hours)
    value = F.least(F.greatest(linear * decay, F.lit(0.0)), F.lit(1.0))
    return F.when(valid, F.struct(linear.alias("linear"), decay.alias("decay"), value.alias("score")))

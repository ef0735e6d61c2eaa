"""Risk and severity expressions over finding columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.functions.text import lookup


def risk_raw(type_: Column, category: Column, confidence: Column, complexity: Column) -> Column:
    """Unrounded score. The order of operations is kept, so doubles are reproducible."""
    base = (F.lit(0.5) + lookup(type_, fv.RULE_DELTAS, 0.0)
            + lookup(category, fv.CATEGORY_DELTAS, 0.0))
    shrunk = base * confidence + (F.lit(1.0) - confidence) * F.lit(0.5)
    boost = F
    for limit, value in fv.COMPLEXITY_BOOSTS:
        boost = boost.when(complexity >= limit, F.lit(value))
    return F.greatest(F.lit(fv.SCORE_FLOOR),
                      F.least(F.lit(fv.SCORE_CEILING), shrunk + boost.otherwise(F.lit(0.0))))


def rounded(score: Column) -> Column:
    """Three decimals, rounded by the exact value of the double, ties to even.

    The product with 1000 has an exact rest: both halves of the score (split by 2**27 + 1) times 1000 are doubles.
    """
    wide = score * F.lit(134217729.0)
    high = wide - (wide - score)
    product = score * F.lit(1000.0)
    rest = (high * F.lit(1000.0) - product) + (score - high) * F.lit(1000.0)
    whole = F.floor(product).cast("double")
    over = product - whole - F.lit(0.5)  # exact; the rest decides where it is zero
    up = (over > 0) | ((over == 0) & ((rest > 0) | ((rest == 0) & (whole % 2 == 1))))
    return (whole + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(1000.0)


def severity(score: Column) -> Column:
    """Band of the unrounded score."""
    band = F
    for limit, name in fv.SEVERITY_BANDS:
        band = band.when(score >= limit, F.lit(name))
    return band.otherwise(F.lit(fv.LOWEST_SEVERITY))


def confidence_severity(confidence: Column) -> Column:
    return (F.when(confidence >= fv.HIGH_CONFIDENCE, F.lit("high"))
            .when(confidence >= 0.5, F.lit("medium")).otherwise(F.lit("low")))


def type_category(type_: Column) -> Column:
    """Category of a finding type, from the rule tables."""
    table = {t: c for t, c, *_ in [*fv.CALL_SINKS.values(), *fv.PY_RULES.values(),
                                   *fv.JS_RULES.values()]}
    return lookup(type_, table, "CODE_SMELL")

"""Column expressions over numbers: parsing, magnitude buckets, degree weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
BUCKETS = ((1e3, "tiny"), (1e5, "small"), (1e6, "medium"), (1e8, "large"), (1e9, "very_large"))


def parse(c: Column) -> Column:
    """A number from text: currency and percent signs and thousands separators go, K M B become powers of ten; NULL if it is none."""
    t = F.regexp_replace(F.trim(c.cast("string")), r"[$,%]", "")
    for suffix, power in (("M", "e6"), ("B", "e9"), ("K", "e3")):
        t = F.replace(t, F.lit(suffix), F.lit(power))
    t = F.trim(t)
    return F.when(t.rlike(_FLOAT), t.try_cast("double"))


def bucket(x: Column) -> Column:
    """Order of magnitude; zero and below are `zero`, NaN is NULL."""
    out = F.when(F.isnan(x), F.lit(None)).when(x <= 0, "zero")
    for limit, name in BUCKETS:
        out = out.when(x < limit, name)
    return F.when(x.isNull(), F.lit(None)).otherwise(out.otherwise("massive"))


def idf(degree: Column) -> Column:
    """Weight of a shared node: 1 up to degree 1, else 1 / ln(degree + 1)."""
    return F.when(degree <= 1, 1.0).otherwise(1.0 / F.log(degree + 1))

"""Column expressions over dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tried in this order; an ambiguous day and month is read month first.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "yyyy/M/d", "MMM d, yyyy", "MMMM d, yyyy")


def parse(c: Column) -> Column:
    """A timestamp from ISO text, one of FORMATS, or epoch seconds; NULL if it is none."""
    t = F.trim(c.cast("string"))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))))
    epoch = F.when(t.rlike(r"^\d{9,10}(\.\d+)?$"), F.timestamp_seconds(t.try_cast("double")))
    return F.coalesce(iso, *(F.try_to_timestamp(t, F.lit(f)) for f in FORMATS), epoch)


def decay(ts: Column, now: Column, rate: float) -> Column:
    """exp(-rate * whole days before `now`), 1 for later times and unreadable ones."""
    days = F.floor((now.cast("timestamp").cast("double") - ts.cast("timestamp").cast("double")) / 86400)
    return F.coalesce(F.exp(F.lit(-rate) * F.greatest(days, F.lit(0))), F.lit(1.0))

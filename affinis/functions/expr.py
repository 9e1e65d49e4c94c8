"""Column-expression helpers.

Everything here returns a built-in ``Column`` expression so it stays
inside whole-stage codegen; there is no Python UDF in this module.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400.0

# Implicit rating of each feedback interaction type.
IMPLICIT_RATING = {"click": 3.0, "add_to_cart": 4.0, "purchase": 5.0, "ignore": 2.0}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts) -> Column:
    """Timestamp -> epoch seconds as DOUBLE (keeps sub-second precision)."""
    return F.unix_micros(col(ts).cast("timestamp")) / F.lit(1_000_000.0)


def days_between(later, earlier) -> Column:
    """(later - earlier) in fractional days."""
    return (F.unix_micros(col(later).cast("timestamp"))
            - F.unix_micros(col(earlier).cast("timestamp"))) / F.lit(86_400_000_000.0)


def weekday_mon0(ts) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6 (Spark ``weekday``)."""
    return F.weekday(col(ts))


def is_weekend(ts) -> Column:
    return weekday_mon0(ts).isin(5, 6)


def implicit_rating(interaction_type) -> Column:
    """Map an interaction type to an implicit rating; NULL when rejected."""
    c = col(interaction_type)
    expr = None
    for name, value in IMPLICIT_RATING.items():
        expr = (F.when(c == name, F.lit(value)) if expr is None
                else expr.when(c == name, F.lit(value)))
    return expr.otherwise(F.lit(None).cast("double"))


def bucket5(rating, lo, hi) -> Column:
    """Equal-width 5-bucket index (0..4) on [lo, hi], last bucket closed.

    NULL for values outside [lo, hi]; when lo == hi the range is widened
    to [lo - 0.5, hi + 0.5] (histogram convention), so every value lands in
    the middle bucket 2.
    """
    r, lo_, hi_ = col(rating), col(lo), col(hi)
    width = (hi_ - lo_) / 5.0
    raw = F.floor((r - lo_) / width).cast("int")
    idx = F.when(hi_ == lo_, F.lit(2)).otherwise(F.least(raw, F.lit(4)))
    return F.when(r.between(lo_, hi_), idx).otherwise(F.lit(None).cast("int"))


def rnd(c, digits: int = 6) -> Column:
    return F.round(col(c), digits)


def stable_hash(*cols, seed=0):
    """60 bits of the MD5 of the columns' text and a seed: the same in any
    engine, so samples and splits can be reproduced outside Spark."""
    text = F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")

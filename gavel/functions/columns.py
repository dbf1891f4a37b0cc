"""Column functions: time, slots, hashing, losses, intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: C, b: C) -> Column:
    """a / b as a double; null where b is 0."""
    return col(a).cast("double") / F.when(col(b) != 0, col(b))


def guarded(a: C, b: C) -> Column:
    """a / b as a double with a denominator of at least 1."""
    return col(a).cast("double") / F.greatest(col(b).cast("double"), F.lit(1.0))


def ts_hour(ts: C) -> Column:
    return F.substring(col(ts), 9, 2).cast("int")


def ts_minute(ts: C) -> Column:
    return F.substring(col(ts), 11, 2).cast("int")


def ts_date(ts: C) -> Column:
    """The date of a 17-digit timestamp; null for a bad one."""
    return F.try_to_timestamp(F.substring(col(ts), 1, 8), F.lit("yyyyMMdd")).cast("date")


def ts_seconds(ts: C) -> Column:
    """Seconds of a 17-digit timestamp."""
    return F.unix_timestamp(F.try_to_timestamp(F.substring(col(ts), 1, 14), F.lit("yyyyMMddHHmmss")))


def weekday(ts: C) -> Column:
    """0 is Monday."""
    return F.weekday(ts_date(ts))


def is_peak(hour: C) -> Column:
    return (col(hour).between(7, 9) | col(hour).between(17, 20)).cast("int")


def hash_bucket(value: C, buckets: int, seed: int = 42) -> Column:
    """md5(value_seed) mod buckets + 1; null is 0. The 128-bit value is reduced 32 bits at a time."""
    digest = F.md5(F.concat(col(value).cast("string"), F.lit(f"_{seed}")))
    rest: Column = F.lit(0).cast("bigint")
    for k in range(4):
        rest = F.pmod(rest * F.lit(1 << 32) + F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint"), F.lit(buckets).cast("bigint"))
    return F.coalesce(rest + 1, F.lit(0)).cast("bigint")


def bid_floor_ratio(bid: C, floor: C) -> Column:
    return F.least(F.greatest(F.bround(col(bid) / F.when(col(floor) == 0, 1).otherwise(col(floor)).cast("double"), 3), F.lit(0.0)), F.lit(100.0))


def cross_entropy(p: C, y: C, eps: float = 1e-7, pos_weight: float = 1.0, focal_gamma: float = 0.0) -> Column:
    """Binary cross-entropy of one row, with a positive weight and a focal exponent."""
    q = F.least(F.greatest(col(p), F.lit(eps)), F.lit(1 - eps))
    at = F.when(col(y) == 1, q).otherwise(1 - q)
    loss = -F.log(at) * F.when(col(y) == 1, F.lit(pos_weight)).otherwise(F.lit(1.0))
    return loss * F.pow(1 - at, F.lit(focal_gamma)) if focal_gamma else loss


def wilson(k: C, n: C, z: float = 1.959964) -> tuple[Column, Column]:
    """Wilson score interval of k of n, clipped to 0..1; null where n is 0."""
    m = F.when(col(n) > 0, col(n).cast("double"))
    p = col(k) / m
    middle = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z / (1 + z * z / m) * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    some = col(n) > 0
    return F.when(some, F.greatest(middle - half, F.lit(0.0))), F.when(some, F.least(middle + half, F.lit(1.0)))


def effect_label(d: C) -> Column:
    a = F.abs(col(d))
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def uniform(key: C, seed: int) -> Column:
    """A number in [0, 1) that is a function of the key and the seed."""
    return F.pmod(F.xxhash64(col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def fold(key: C, k: int, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(col(key), F.lit(seed)), F.lit(k)).cast("int")


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))

"""Column expressions that several operators share."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

from tidemark import schemas as S

#: Sums of weights are kept as decimals, so their order doesn't matter.
EXACT = "decimal(24,12)"


def action_weight(action: str = "action", watch: str = "watch_pct") -> Column:
    """The weight of an event; plays and completions count by the share watched, but by no less than the floor."""
    weight = F.lit(None).cast("decimal(9,4)")
    for name, value in S.WEIGHTS.items():
        weight = F.when(F.col(action) == name, F.lit(value).cast("decimal(9,4)")).otherwise(weight)
    share = F.greatest(F.lit(S.WATCH_FLOOR).cast("decimal(9,4)"), F.col(watch).cast("decimal(9,4)"))
    return F.when(F.col(action).isin(*S.WATCHED), weight * share).otherwise(weight)


def positive_label(action: str = "action", watch: str = "watch_pct") -> Column:
    return F.col(action).isin(*S.POSITIVE) | ((F.col(action) == "play") & (F.col(watch) >= S.LABEL_POSITIVE_WATCH))


def negative_label(action: str = "action", watch: str = "watch_pct") -> Column:
    return F.col(action).isin("skip", "impression") | ((F.col(action) == "play") & (F.col(watch) < S.LABEL_NEGATIVE_WATCH))


def hash_bucket(salt: str, experiment: str, user: Column, buckets: int = S.BUCKETS) -> Column:
    """The first 64 bits of SHA-256 of salt:experiment:user, as a number modulo `buckets`."""
    key = F.concat(F.lit(f"{salt}:{experiment}:"), user)
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % buckets).cast("int")


def bucket_of(salt: str, experiment: str, user: str, buckets: int = S.BUCKETS) -> int:
    """hash_bucket for one user, on the driver."""
    return int.from_bytes(hashlib.sha256(f"{salt}:{experiment}:{user}".encode()).digest()[:8], "big") % buckets


def unused(columns, name: str) -> str:
    """A column name that none of `columns` has, whatever its case."""
    taken = {c.casefold() for c in columns}
    while (name := f"_{name}").casefold() in taken:
        pass
    return name


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def half_up(x: Column, places: int) -> Column:
    """F.round of a double, at a few per cent of its cost: decimal digits are made only for what is near a half."""
    unit = float(10**places)
    y = x * unit
    plain = (F.abs(x) < 1000) & (F.abs(y - F.floor(y) - 0.5) > 1e-3)  # a product's error is below 1e-3 there; NaN isn't plain
    return F.when(plain, F.floor(y + 0.5) / unit).otherwise(F.round(x, places))


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

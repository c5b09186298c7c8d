"""Numeric and time functions (FN23, FN24, FN31-33)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_WIDTH_DAYS = 45.0
SIGMA_DAYS = 15.0


def gaussian_kernel(days: Column) -> Column:
    """FN23: exp(-(d / sigma)**2 / 2) within 45 days, else 0."""
    return F.when(F.abs(days) > HALF_WIDTH_DAYS, 0.0).otherwise(F.exp(-0.5 * (days / SIGMA_DAYS) * (days / SIGMA_DAYS)))


def month_centre(month: Column) -> Column:
    """FN24: unix seconds of the 15th, 12:00 UTC, of a month given by its first day."""
    return F.unix_timestamp(F.date_add(month, 14).cast("timestamp")) + 12 * 3600


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column, epsilon: float = 1e-9) -> Column:
    """FN31 with the guard of the clustering code: divide by norm + epsilon."""
    n = norm(a) + epsilon
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """FN31 with the guard of the deduplication code: a zero vector is similar to nothing."""
    n = norm(a) * norm(b)
    return dot(a, b) / F.when(n == 0, 1.0).otherwise(n)


def zotero_year(raw: Column) -> Column:
    """FN32: the first four-digit year of a free-form date."""
    return F.nullif(F.regexp_extract(raw, r"(\d{4})", 1), F.lit("")).cast("long")


def iso_seconds(raw: Column) -> Column:
    """FN32: unix seconds of an ISO timestamp, null if it isn't one."""
    return F.unix_timestamp(F.try_to_timestamp(raw))


def calibre_year(raw: Column) -> Column:
    """FN32: the year of a Calibre timestamp; the placeholder year 101 is no year."""
    year = F.year(F.try_to_timestamp(raw))
    return F.when(year > 101, year.cast("long"))


def adaptive_cluster_params(n: int) -> tuple[int, int, int]:
    """FN33: minimum cluster size, minimum samples and neighbours for n documents."""
    if n < 8:
        return max(2, n // 3), 2, max(2, n - 1)
    size = min(50, max(3, round(n**0.5 / 2)))
    return size, max(2, size // 2), max(5, min(30, n // 4))

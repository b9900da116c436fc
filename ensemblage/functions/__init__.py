"""Column helpers: missing values, percentiles, numbers as text, hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)


def finite_or_null(c: Column) -> Column:
    """NaN and infinities become null, which aggregates skip."""
    return F.when(finite(c), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in all floating columns: what loaders of arrays need."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n, k in kinds.items() if k in ("double", "float")})


def quantile(c: Column, q: float) -> Column:
    """Exact quantile with linear interpolation, over finite values."""
    return F.percentile(finite_or_null(c), q)


def iqr(c: Column) -> Column:
    return quantile(c, 0.75) - quantile(c, 0.25)


def strict_median(c: Column) -> Column:
    """Median that is NaN as soon as one value is missing."""
    return F.when(F.max((~finite(c)).cast("int")) == 1, F.lit(float("nan"))).otherwise(F.percentile(c, 0.5))


def standard_error(c: Column) -> Column:
    """Null for fewer than two values."""
    return F.try_divide(F.stddev_samp(c), F.sqrt(F.count(c).cast("double")))


def reduction_percent(base: Column, new: Column) -> Column:
    """100 (base - new) / base, null where base is 0."""
    return F.try_divide(100.0 * (base - new), base)


def clip(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def compact_number(c: Column) -> Column:
    """Up to six decimals without trailing zeros, as ``%g`` writes common values."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c.cast("double")), r"0+$", ""), r"\.$", "")


def safe_name(c: Column, most: int = 120) -> Column:
    """File name of an id: odd characters become _, long names end in a sha1 part."""
    clean = F.regexp_replace(c, r"[^A-Za-z0-9._=-]+", "_")
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.substring(clean, 1, most), F.lit("_"), F.substring(F.sha1(c), 1, 10)))


def seed_of(c: Column) -> Column:
    """A 60-bit seed from an id."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10).cast("long")


def lookup(mapping: dict, c: Column, default) -> Column:
    """Value of a small mapping, for ordinals of categories and the like."""
    found = F.lit(default)
    for k, v in mapping.items():
        found = F.when(c == k, v).otherwise(found)
    return found

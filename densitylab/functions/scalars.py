"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean a missing phenotype.
MISSING_TOKENS = ["", "NA", "NaN", "nan"]


def variant_id(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", chrom.cast("string"), pos.cast("string"), ref, alt)


def salted_digest(salt: str, key: Column) -> Column:
    """SHA-256 of salt, NUL and key; its hexadecimal text sorts as its bytes."""
    return F.sha2(F.concat(F.lit(salt), F.lit("\0"), key.cast("string")), 256)


def tabbed_digest(*keys: Column | str | int) -> Column:
    """SHA-256 of the keys' texts joined by tabs."""
    return F.sha2(F.concat_ws("\t", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]), 256)


def bin_number(pos: Column, width: int) -> Column:
    return F.floor(pos / F.lit(width)).cast("bigint")


def centred(g: Column, mean: Column) -> Column:
    """Deviation from the training mean; a missing call deviates by nothing."""
    return F.coalesce(g - mean, F.lit(0.0))


def minor_frequency(p: Column) -> Column:
    return F.least(p, 1 - p)


def minor_count(total: Column, called: Column) -> Column:
    return F.least(total, 2 * called - total)


def number_or_null(raw: Column) -> Column:
    """A phenotype's text as a double; missing tokens are null, other text is an error."""
    text = F.trim(raw)
    return F.when(text.isin(MISSING_TOKENS), F.lit(None)).otherwise(text).cast("double")


def finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == float("inf")))


def single_rounded(x: Column) -> Column:
    """Rounded to a 32-bit float, as a double."""
    return x.cast("float").cast("double")


def zero_based(fold: Column) -> Column:
    return fold.cast("int") - 1


def pearson(x: Column, y: Column) -> Column:
    """Aggregate; null for fewer than two rows or a constant side, where ``corr`` would fail."""
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))))


def called(g: Column, storage: str) -> Column:
    """Null for a missing dosage: -1 in int8 storage, NaN in floats."""
    if storage == "int8":
        return F.when(g != -1, g)
    return F.when(~F.isnan(g), g)

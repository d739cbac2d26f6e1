"""Content identity: canonical JSON text and digests."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _number_text(value: float) -> str:
    """Shortest decimal text: no exponent from 1e-6 up to 1e21, no trailing ``.0``."""
    if value == 0:
        return "0"
    if 1e-6 <= abs(value) < 1e21:
        return format(Decimal(repr(value)), "f").removesuffix(".0")
    mantissa, exponent = f"{Decimal(repr(value)):e}".split("e")
    mantissa = mantissa.rstrip("0").rstrip(".") if "." in mantissa else mantissa
    return f"{mantissa}e{int(exponent):+d}"


@F.pandas_udf(StringType())
def _exact_number(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if pd.isna(v) else _number_text(float(v)))


def number_text(value: Column, *, exact: bool = False) -> Column:
    """JSON text of a number, whole doubles without a fraction.

    The native form keeps equal numbers equal; ``exact`` also fixes the notation of
    very small and very large fractions, in Arrow batches.
    """
    if exact:
        return _exact_number(value.cast("double"))
    double = value.cast("double")
    whole = (double == F.floor(double)) & (F.abs(double) < 1e15)
    return F.when(whole, double.cast("long").cast("string")).otherwise(double.cast("string"))


def string_text(value: Column) -> Column:
    """JSON string literal of a text column."""
    wrapped = F.to_json(F.array(value))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def canonical_json(strings: dict[str, Column], numbers: dict[str, Column], *, exact: bool = False) -> Column:
    """Object text with sorted keys and no spaces; null fields are left out."""
    parts = {
        **{k: string_text(v) for k, v in strings.items()},
        **{k: number_text(v, exact=exact) for k, v in numbers.items()},
    }
    values = {**strings, **numbers}
    items = [
        F.when(values[k].isNotNull(), F.concat(F.lit(f'"{k}":'), parts[k])) for k in sorted(parts)
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}"))


def fingerprint(strings: dict[str, Column], numbers: dict[str, Column] | None = None, *, exact: bool = False) -> Column:
    return F.sha2(canonical_json(strings, numbers or {}, exact=exact), 256)


def set_digest(value: Column) -> dict[str, Column]:
    """Aggregates identifying a set of distinct values without gathering it: size and two xor folds.

    They combine map-side, so the digest of a huge group costs no more than a count.
    """
    return {
        "n": F.count(value),
        "x": F.bit_xor(F.xxhash64(value)),
        "y": F.bit_xor(F.xxhash64(F.lit("second"), value)),
    }

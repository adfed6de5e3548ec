"""Scalar expressions: prices, labels, codes and seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNDEFINED_PRICE = (1 << 63) - 1
#: Vendor letters and their codes; others are a modification, and no side.
ACTION_CODES = {"A": 0, "C": 1, "M": 2, "T": 3, "F": 3, "R": 4}
SIDE_CODES = {"B": 1, "A": -1, "N": 0}


def coded(letter: Column, codes: dict[str, int], default: int) -> Column:
    table = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    return F.coalesce(F.try_element_at(table, letter), F.lit(default))


def price_ticks(fixed: Column, tick: float) -> Column:
    """Ticks of a price in units of 1e-9, half to even; null where undefined."""
    return F.when(fixed != UNDEFINED_PRICE, F.rint(fixed * 1e-9 / tick).cast("long"))


def logit(p: Column, at: float = 1e-6) -> Column:
    p = F.greatest(F.lit(at), F.least(F.lit(1 - at), p))
    return F.log(p / (1 - p))


def day_seed(*parts: Column) -> Column:
    """32-bit seed from the SHA-256 of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 8), 16, 10).cast("long")


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def zip_strict(**arrays: Column) -> Column:
    """Array of structs from arrays by position; arrays of different sizes are an error."""
    first, *others = arrays.values()
    same = F.lit(True)
    for x in others:
        same = same & (F.size(x) == F.size(first))
    return F.when(same, F.arrays_zip(*(x.alias(k) for k, x in arrays.items()))).otherwise(F.raise_error(F.lit("arrays of different sizes")))

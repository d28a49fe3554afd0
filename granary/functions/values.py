"""Small value expressions: money, flags, parameters, padding, rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(c: Column | str) -> Column:
    """Exact two-place amount, so that sums do not depend on the order of rows."""
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def cents_to_dollars(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (c.cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(16,2)")


def floor_round(c: Column, places: int) -> Column:
    """Round half up on doubles by floor, the form that is equal in every engine."""
    scale = float(10 ** places)
    return F.floor(c * scale + 0.5) / scale


def exact_avg(total: Column, n: Column) -> Column:
    """Average from an exact total; null for an empty group."""
    return total.cast("double") / F.nullif(n, F.lit(0))


def param(params: Column | str, key: str, field: str) -> Column:
    """Value of one key in an array of {key, value{...}} structs, without exploding it."""
    hit = F.filter(params, lambda p: p["key"] == key)
    return F.try_element_at(hit, F.lit(1))["value"][field]


def pad_right(c: Column, width: int, fill: str = "0") -> Column:
    return F.rpad(c, width, fill)


def first_failure(c: Column) -> Column:
    """Name of the first rule a text breaks, null when it passes all."""
    return (
        F.when(F.octet_length(c) < 8, "too_short")
        .when(~c.rlike(r"\p{Lu}"), "no_uppercase")
        .when(~c.rlike(r"\p{Ll}"), "no_lowercase")
        .when(~c.rlike("[0-9]"), "no_digit")
    )


def twos_exponent(c: Column) -> Column:
    """How often 2 divides a positive integer: the number of zero bits below the lowest one."""
    return F.bit_count(c.bitwiseAND(-c) - 1)

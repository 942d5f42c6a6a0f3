"""Column expressions for units.  The tables are small and fixed, so they are literals."""

from __future__ import annotations

from functools import cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import units as registry
from .text import strip


@cache
def _tables() -> tuple[dict[str, str], dict[str, float]]:
    return registry.aliases(), {f"{a}>{b}": f for (a, b), f in registry.factors().items()}


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def canonical(unit: Column) -> Column:
    """The canonical spelling; unknown units as written, null as the empty text."""
    u = strip(F.coalesce(unit, F.lit("")))
    return F.coalesce(F.try_element_at(_map(_tables()[0]), F.lower(u)), u)


def factor(source: Column, target: Column) -> Column:
    """What to multiply by; 1 for equal units, none, and pairs that aren't known.  Both are canonical."""
    known = F.try_element_at(_map(_tables()[1]), F.concat(source, F.lit(">"), target))
    return F.when((source == "") | (source == target), F.lit(1.0)).otherwise(F.coalesce(known, F.lit(1.0)))


def converted(x: Column, source: Column, target: Column) -> Column:
    """x in the target unit, rounded to 6 decimals; both units are canonical.

    Temperatures go by way of degrees Celsius, others by their factor: one formula,
    in which x stands once, so that a filter on the result doesn't multiply x's code.
    """
    warm = source.isin(*registry.TEMPERATURES) & target.isin(*registry.TEMPERATURES)
    of = lambda unit, fahrenheit, kelvin, other: F.when(warm & (unit == "°F"), fahrenheit).when(warm & (unit == "K"), kelvin).otherwise(other)
    celsius = (x - of(source, 32.0, 273.15, 0.0)) * F.when(warm, of(source, 5.0, 1.0, 1.0)).otherwise(factor(source, target)) / of(source, 9.0, 1.0, 1.0)
    return F.round(celsius * of(target, 9.0, 1.0, 1.0) / of(target, 5.0, 1.0, 1.0) + of(target, 32.0, 273.15, 0.0), 6)


def to_unit(x: Column, source: Column, target: Column) -> Column:
    """x in the target unit, rounded to 6 decimals, whatever the units' spellings."""
    return converted(x, canonical(source), canonical(target))

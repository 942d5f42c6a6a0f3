"""Plausibility rules as Catalyst predicates over a product's fused fields.

A rule reads one to three fields, runs only if all have a value, and reports an
issue on the first of them.  Rules aren't tied to a category: any product with the
fields runs them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column

ERROR, WARNING = "error", "warning"


@dataclass(frozen=True)
class Rule:
    """`message` names the values by place, `{0}` to `{2}`, or all as a list, `{*}`."""

    id: str
    severity: str
    fields: tuple[str, ...]
    holds: Callable[..., Column]
    message: str


def _unit(unit: str) -> str:
    return f" {unit}" if unit and unit != "%" else unit


def positive(id: str, field: str, unit: str) -> Rule:
    return Rule(id, ERROR, (field,), lambda v: v > 0, f"{field} must be > 0 (got {{0}}{_unit(unit)})")


def within(id: str, field: str, low: float, high: float, unit: str, severity: str = WARNING, span: str | None = None, open_low: bool = False) -> Rule:
    text = span or f"sane range ({low:g}-{high:.15g}{_unit(unit)})"
    holds = lambda v: ((v > low) if open_low else (v >= low)) & (v <= high)
    return Rule(id, severity, (field,), holds, f"{field} {{0}}{_unit(unit)} outside {text}")


def all_positive(id: str, fields: tuple[str, ...], what: str) -> Rule:
    return Rule(id, ERROR, fields, lambda *v: reduce(lambda a, b: a & b, [x > 0 for x in v]), f"{what} must be > 0 (got {{*}})")


def below(id: str, small: str, large: str, unit: str, severity: str = ERROR, word: str = "below") -> Rule:
    return Rule(id, severity, (small, large), lambda a, b: a < b, f"{small} ({{0}} {unit}) must be {word} {large} ({{1}} {unit})")


RULES: tuple[Rule, ...] = (
    below("bore_lt_outer", "bore_diameter", "outer_diameter", "mm", word="smaller than"),
    below("width_lt_outer", "width", "outer_diameter", "mm", word="smaller than"),
    all_positive("dims_positive", ("bore_diameter", "outer_diameter", "width"), "dimensions"),
    Rule("dynamic_ge_static", ERROR, ("dynamic_load_rating", "static_load_rating"), lambda a, b: a >= b, "dynamic_load_rating ({0} kN) cannot be below static_load_rating ({1} kN)"),
    all_positive("loads_positive", ("dynamic_load_rating", "static_load_rating"), "load ratings"),
    positive("speed_positive", "max_speed", "rpm"),
    within("weight_sane", "weight", 0.001, 500, "kg"),
    below("temp_min_lt_max", "temperature_range_min", "temperature_range_max", "°C"),
    Rule("temp_sane_bounds", WARNING, ("temperature_range_min", "temperature_range_max"), lambda a, b: (a >= -80) & (b <= 400), "temperature range [{0}, {1}] °C outside sane bounds (-80..400 °C)"),
    positive("motor_power_positive", "power_kw", "kW"),
    within("motor_power_sane", "power_kw", 0.01, 50000, "kW"),
    positive("motor_voltage_positive", "rated_voltage", "V"),
    within("motor_voltage_sane", "rated_voltage", 12, 15000, "V"),
    positive("motor_current_positive", "rated_current", "A"),
    positive("motor_speed_positive", "rated_speed", "rpm"),
    within("motor_speed_sane", "rated_speed", 100, 40000, "rpm"),
    within("motor_efficiency_range", "efficiency", 0, 100, "%", ERROR, "0..100% range", open_low=True),
    within("motor_freq_sane", "frequency", 5, 1000, "Hz", span="sane range (5..1000 Hz)"),
    within("motor_weight_sane", "weight", 0.1, 10000, "kg"),
    positive("valve_conn_positive", "connection_size", "mm"),
    within("valve_conn_sane", "connection_size", 1, 2000, "mm"),
    positive("valve_pressure_positive", "pressure_rating", "bar"),
    within("valve_pressure_sane", "pressure_rating", 0.1, 1000, "bar"),
    positive("gb_ratio_positive", "ratio", ""),
    within("gb_ratio_sane", "ratio", 1, 10000, ""),
    within("gb_input_speed_sane", "input_speed", 100, 20000, "rpm"),
    positive("gb_output_positive", "output_speed", "rpm"),
    Rule("gb_output_lt_input", WARNING, ("input_speed", "output_speed"), lambda a, b: a > b, "output_speed ({1} rpm) must be below input_speed ({0} rpm)"),
    positive("gb_torque_positive", "rated_torque", "N·m"),
    within("gb_torque_sane", "rated_torque", 0.05, 5000000, "N·m"),
)

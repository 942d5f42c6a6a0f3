"""Product categories: their fields, types, canonical units and closed domains.

A category is data.  `Category.from_json` reads a user's own schema document; the
four built-in ones are stated below.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache

# Category | label | version
CATEGORIES = """
deep_groove_ball_bearing | Deep groove ball bearing | 1.0
2_way_ball_valve | Two-way ball valve | 1.0
electric_motor | Three-phase induction motor | 1.0
helical_gear_reducer | Helical gear reducer | 1.0
"""

# Category | field | label | type | canonical unit | closed domain
FIELDS = """
deep_groove_ball_bearing | part_number | Part number | string | - | -
deep_groove_ball_bearing | brand | Brand | string | - | -
deep_groove_ball_bearing | bore_diameter | Bore diameter (d) | number | mm | -
deep_groove_ball_bearing | outer_diameter | Outer diameter (D) | number | mm | -
deep_groove_ball_bearing | width | Width (B) | number | mm | -
deep_groove_ball_bearing | dynamic_load_rating | Dynamic load rating (C) | number | kN | -
deep_groove_ball_bearing | static_load_rating | Static load rating (C0) | number | kN | -
deep_groove_ball_bearing | max_speed | Max speed | number | rpm | -
deep_groove_ball_bearing | weight | Weight | number | kg | -
deep_groove_ball_bearing | seal_type | Seal type | enum | - | open, RS, 2RS, 2Z, ZZ, 2RU
deep_groove_ball_bearing | clearance | Internal clearance | enum | - | C2, CN, C3, C4, C5
deep_groove_ball_bearing | temperature_range_min | Min operating temp | number | °C | -
deep_groove_ball_bearing | temperature_range_max | Max operating temp | number | °C | -
deep_groove_ball_bearing | country_of_origin | Country of origin | string | - | -
deep_groove_ball_bearing | precision_grade | Precision grade | enum | - | ABEC 1, ABEC 3, ABEC 5, ABEC 7, P0, P6, P5
deep_groove_ball_bearing | material | Material | string | - | -
2_way_ball_valve | part_number | Part number | string | - | -
2_way_ball_valve | brand | Brand | string | - | -
2_way_ball_valve | connection_size | Connection size (DN) | number | mm | -
2_way_ball_valve | pressure_rating | Pressure rating (PN) | number | bar | -
2_way_ball_valve | body_material | Body material | enum | - | brass, stainless_steel, cast_iron, pvc
2_way_ball_valve | actuation | Actuation | enum | - | manual, pneumatic, electric
2_way_ball_valve | temperature_range_min | Min operating temp | number | °C | -
2_way_ball_valve | temperature_range_max | Max operating temp | number | °C | -
2_way_ball_valve | weight | Weight | number | kg | -
electric_motor | part_number | Part number | string | - | -
electric_motor | brand | Brand | string | - | -
electric_motor | power_kw | Rated output power | number | kW | -
electric_motor | rated_voltage | Rated voltage | number | V | -
electric_motor | rated_current | Rated current | number | A | -
electric_motor | rated_speed | Rated speed | number | rpm | -
electric_motor | efficiency | Efficiency | number | % | -
electric_motor | frequency | Frequency | number | Hz | -
electric_motor | frame_size | Frame size | enum | - | 80, 90S, 90L, 100L, 112M, 132S, 132M, 160M, 160L, 180M, 200L, 225S, 225M, 250M
electric_motor | protection_class | Protection class | enum | - | IP44, IP55, IP56, IP65, IP66, IP67
electric_motor | insulation_class | Insulation class | enum | - | B, F, H
electric_motor | mounting | Mounting | enum | - | B3, B5, B35, V1, V3
electric_motor | weight | Weight | number | kg | -
helical_gear_reducer | part_number | Part number | string | - | -
helical_gear_reducer | brand | Brand | string | - | -
helical_gear_reducer | ratio | Gear ratio | number | - | -
helical_gear_reducer | input_speed | Input speed | number | rpm | -
helical_gear_reducer | output_speed | Output speed | number | rpm | -
helical_gear_reducer | rated_torque | Rated torque | number | Nm | -
helical_gear_reducer | service_factor | Service factor | number | - | -
helical_gear_reducer | efficiency | Efficiency | number | % | -
helical_gear_reducer | mounting | Mounting | enum | - | B3, B5, B14, V1, V6
helical_gear_reducer | protection_class | Protection class | enum | - | IP44, IP55, IP56, IP65, IP66
helical_gear_reducer | lubrication | Lubrication | enum | - | oil, grease
helical_gear_reducer | weight | Weight | number | kg | -
"""

DEFAULT_CATEGORY = "deep_groove_ball_bearing"


@dataclass(frozen=True)
class Field:
    name: str
    label: str
    type: str = "string"
    unit: str | None = None
    enum: tuple[str, ...] = ()


@dataclass(frozen=True)
class Category:
    name: str
    label: str
    version: str
    fields: tuple[Field, ...]

    @classmethod
    def from_json(cls, text: str) -> Category:
        """A schema document: category, category_label, version, fields[name, label, type, unit, enum]."""
        d = json.loads(text)
        fields = tuple(Field(f["name"], f.get("label", f["name"]), f.get("type", "string"), f.get("unit"), tuple(f.get("enum") or ())) for f in d["fields"])
        return cls(d["category"], d.get("category_label", d["category"]), d.get("version", ""), fields)


def _cells(table: str) -> list[list[str]]:
    return [[c.strip() for c in line.split(" | ")] for line in table.strip().splitlines()]


@cache
def builtin() -> tuple[Category, ...]:
    out = []
    for name, label, version in _cells(CATEGORIES):
        own = [r[1:] for r in _cells(FIELDS) if r[0] == name]
        fields = tuple(Field(f, lab, kind, None if unit == "-" else unit, () if enum == "-" else tuple(enum.split(", "))) for f, lab, kind, unit, enum in own)
        out.append(Category(name, label, version, fields))
    return tuple(out)

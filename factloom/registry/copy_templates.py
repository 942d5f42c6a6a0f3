"""Sentences of the product description; each needs all its fields verified."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Sentence:
    category: str
    text: str
    phrases: dict[str, dict[str, str]] = field(default_factory=dict)

    @property
    def uses(self) -> tuple[str, ...]:
        """The fields in the order in which the text names them first."""
        return tuple(dict.fromkeys(re.findall(r"\{\{(\w+)\}\}", self.text)))


# The sentences and phrases of each category
SENTENCES: tuple[Sentence, ...] = (
    Sentence(
        "deep_groove_ball_bearing",
        "The {{part_number}} is a {{seal_type}} deep groove ball bearing with a {{bore_diameter}} mm bore, {{outer_diameter}} mm outer diameter and {{width}} mm width.",
        {"seal_type": {"2RS": "sealed", "2Z": "shielded", "2RU": "sealed", "open": "open"}},
    ),
    Sentence("deep_groove_ball_bearing", "It is rated for a dynamic load of {{dynamic_load_rating}} kN and a static load of {{static_load_rating}} kN."),
    Sentence("deep_groove_ball_bearing", "Operating temperature range is {{temperature_range_min}} °C to {{temperature_range_max}} °C."),
    Sentence("deep_groove_ball_bearing", "Maximum limiting speed is {{max_speed}} rpm."),
    Sentence("deep_groove_ball_bearing", "The unit weighs {{weight}} kg."),
    Sentence("electric_motor", "The {{part_number}} is an {{insulation_class}}-class, {{protection_class}} three-phase induction motor rated {{power_kw}} kW at {{rated_speed}} rpm."),
    Sentence("electric_motor", "It runs on {{rated_voltage}} V at {{frequency}} Hz, drawing {{rated_current}} A at {{efficiency}}% efficiency."),
    Sentence("electric_motor", "The unit weighs {{weight}} kg."),
    Sentence("2_way_ball_valve", "The {{part_number}} is a {{body_material}} {{actuation}} two-way ball valve with a {{connection_size}} mm connection, rated to {{pressure_rating}} bar."),
    Sentence("2_way_ball_valve", "Operating temperature range is {{temperature_range_min}} °C to {{temperature_range_max}} °C."),
    Sentence("2_way_ball_valve", "The unit weighs {{weight}} kg."),
)

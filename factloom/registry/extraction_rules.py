"""Extraction rules: which pattern on a line yields which field.

Patterns are searched in a line's stripped text; the first line that matches wins.
A rule's value is the text of a capture group, after a step (without blanks, without
white space at its ends, in title case, or after a constant), or a constant alone.
Its unit is stated, or the text of another group.
"""

from __future__ import annotations

from dataclasses import dataclass

METHODS = ("table_parse", "llm_inference", "ocr_heuristic")
BEARING, MOTOR, VALVE, REDUCER = "deep_groove_ball_bearing", "electric_motor", "2_way_ball_valve", "helical_gear_reducer"


@dataclass(frozen=True)
class ExtractionRule:
    category: str
    source_type: str
    field: str
    pattern: str
    group: int = 1
    step: str = "identity"
    constant: str | None = None
    unit: str | None = None
    unit_group: int = 0
    confidence: float = 0.95
    method: str = "table_parse"


# The rules in their order
RULES: tuple[ExtractionRule, ...] = (
    ExtractionRule(BEARING, "pdf", "part_number", r"(?i)^(?:SKF\s+)?(62\d{2}[\w-]*)\s+DEEP GROOVE"),
    ExtractionRule(BEARING, "pdf", "brand", r"^(SKF)\s+62\d{2}[\w-]*"),
    ExtractionRule(BEARING, "pdf", "bore_diameter", r"^d \[mm\]\s+(\d+(?:[.,]\d+)?)", unit="mm"),
    ExtractionRule(BEARING, "pdf", "outer_diameter", r"^D \[mm\]\s+(\d+(?:[.,]\d+)?)", unit="mm"),
    ExtractionRule(BEARING, "pdf", "width", r"^B \[mm\]\s+(\d+(?:[.,]\d+)?)", unit="mm"),
    ExtractionRule(BEARING, "pdf", "dynamic_load_rating", r"Basic dynamic load rating C\s+([\d\s.,]+)\s*(kN|N)", step="nospace", unit="kN"),
    ExtractionRule(BEARING, "pdf", "static_load_rating", r"Basic static load rating C0\s+([\d\s.,]+)\s*(kN|N)", step="nospace", unit="kN"),
    ExtractionRule(BEARING, "pdf", "max_speed", r"Limiting speed\s+([\d\s.]+)\s*(r/min|rpm)", step="nospace", unit="rpm"),
    ExtractionRule(BEARING, "pdf", "weight", r"^Mass\s+([\d.]+)\s*(kg|g|lb)", unit_group=2),
    ExtractionRule(BEARING, "pdf", "seal_type", r"Seal\s+Contact seal,\s*RS1? on both sides", group=0, constant="2RS", method="llm_inference"),
    ExtractionRule(BEARING, "pdf", "clearance", r"^Internal clearance\s+(C[0-5]|CN)"),
    ExtractionRule(BEARING, "web", "part_number", r"^(\d{4}-2RS[\w-]*)\b", confidence=0.85, method="llm_inference"),
    ExtractionRule(BEARING, "web", "bore_diameter", r"Bore:\s*(\d+(?:[.,]\d+)?)\s*mm", unit="mm"),
    ExtractionRule(BEARING, "web", "outer_diameter", r"(?:OD|outer diameter)\s*[: ]\s*(\d+(?:[.,]\d+)?)\s*mm", unit="mm"),
    ExtractionRule(BEARING, "web", "width", r"Width:\s*(\d+(?:[.,]\d+)?)\s*mm", unit="mm"),
    ExtractionRule(BEARING, "web", "dynamic_load_rating", r"Dynamic load rating\s*(?:[|:]\s*)?([\d\s.,]+)\s*(kN|N)", step="nospace", unit_group=2),
    ExtractionRule(BEARING, "web", "static_load_rating", r"Static load rating\s*(?:[|:]\s*)?([\d\s.,]+)\s*(kN|N)", step="nospace", unit_group=2),
    ExtractionRule(BEARING, "web", "max_speed", r"Max speed[^\n]*?([\d\s.,]+)\s*(rpm|r/min)", step="nospace", unit="rpm", confidence=0.85),
    ExtractionRule(BEARING, "web", "temperature_range_min", r"Operating temperature[^\n]*?([+-]?\d+)\s*°C\s+to\s+([+-]?\d+)\s*°C", unit="°C"),
    ExtractionRule(BEARING, "web", "temperature_range_max", r"Operating temperature[^\n]*?([+-]?\d+)\s*°C\s+to\s+([+-]?\d+)\s*°C", group=2, unit="°C"),
    ExtractionRule(BEARING, "web", "seal_type", r"Seal\s*(?:[|:]\s*)?(2RS|2Z|ZZ|RS|open)"),
    ExtractionRule(BEARING, "web", "weight", r"Weight\s*[:| ]+([\d\s.,]+)\s*(kg|g|lb)", step="nospace", unit_group=2),
    ExtractionRule(BEARING, "web", "clearance", r"Internal clearance\s*(?:[|:]\s*)?(C[0-5]|CN)"),
    ExtractionRule(BEARING, "web", "country_of_origin", r"Made in\s*(?:[|:]\s*)?([A-Za-z]+)"),
    ExtractionRule(BEARING, "ocr", "bore_diameter", r"^(\d{2,3})x(\d{2,3})x(\d{2,3})$", unit="mm", confidence=0.7, method="llm_inference"),
    ExtractionRule(BEARING, "ocr", "outer_diameter", r"^(\d{2,3})x(\d{2,3})x(\d{2,3})$", group=2, unit="mm", confidence=0.7, method="llm_inference"),
    ExtractionRule(BEARING, "ocr", "width", r"^(\d{2,3})x(\d{2,3})x(\d{2,3})$", group=3, unit="mm", confidence=0.7, method="llm_inference"),
    ExtractionRule(BEARING, "ocr", "seal_type", r"^(2RS|2Z|ZZ|RS)$", confidence=0.6, method="ocr_heuristic"),
    ExtractionRule(BEARING, "ocr", "seal_type", r"^(2R5)$", confidence=0.55, method="ocr_heuristic"),
    ExtractionRule(BEARING, "ocr", "country_of_origin", r"^([A-Z]{2,10})$", step="title", confidence=0.6, method="ocr_heuristic"),
    ExtractionRule(BEARING, "ocr", "precision_grade", r"^ABEC\s*(\d)$", step="after", constant="ABEC ", confidence=0.55, method="ocr_heuristic"),
    ExtractionRule(MOTOR, "pdf", "part_number", r"^Part no\.?\s+([A-Z0-9\-]+)"),
    ExtractionRule(MOTOR, "pdf", "brand", r"^Brand\s+([A-Za-z]+)"),
    ExtractionRule(MOTOR, "pdf", "power_kw", r"Output power\s+([\d.]+)\s*(kW|HP|hp)\b", unit_group=2),
    ExtractionRule(MOTOR, "pdf", "rated_voltage", r"Rated voltage\s+([\d.]+)\s*V\b", unit="V"),
    ExtractionRule(MOTOR, "pdf", "rated_current", r"Rated current\s+([\d.]+)\s*A\b", unit="A"),
    ExtractionRule(MOTOR, "pdf", "rated_speed", r"Rated speed\s+([\d\s.,]+)\s*(r/min|rpm)", step="nospace", unit="rpm"),
    ExtractionRule(MOTOR, "pdf", "frequency", r"Frequency\s+([\d.]+)\s*Hz", unit="Hz"),
    ExtractionRule(MOTOR, "pdf", "efficiency", r"Efficiency\s+([\d.]+)\s*%", unit="%"),
    ExtractionRule(MOTOR, "pdf", "frame_size", r"Frame size\s+(\d{3}[A-Z]?)"),
    ExtractionRule(MOTOR, "pdf", "protection_class", r"Protection\s+(IP\d+)"),
    ExtractionRule(MOTOR, "pdf", "insulation_class", r"Insulation class\s+([A-Z])"),
    ExtractionRule(MOTOR, "pdf", "mounting", r"Mounting\s+([A-Z0-9]+)"),
    ExtractionRule(MOTOR, "pdf", "weight", r"^Mass\s+([\d.]+)\s*(kg|g)", unit="kg"),
    ExtractionRule(MOTOR, "web", "part_number", r"^([A-Z0-9\-]+)\s+Induction Motor", confidence=0.85, method="llm_inference"),
    ExtractionRule(MOTOR, "web", "power_kw", r"Output power\s*(?:[|:]\s*)?([\d.]+)\s*(kW|HP|hp)\b", unit_group=2),
    ExtractionRule(MOTOR, "web", "rated_voltage", r"(?:Voltage|Rated voltage)\s*(?:[|:]\s*)?([\d.]+)\s*V\b", unit="V"),
    ExtractionRule(MOTOR, "web", "rated_current", r"Rated current\s*(?:[|:]\s*)?([\d.]+)\s*A\b", unit="A"),
    ExtractionRule(MOTOR, "web", "rated_speed", r"Rated speed\s*(?:[|:]\s*)?([\d\s.,]+)\s*(rpm|r/min)", step="nospace", unit="rpm"),
    ExtractionRule(MOTOR, "web", "efficiency", r"Efficiency\s*(?:[|:]\s*)?([\d.]+)\s*%", unit="%"),
    ExtractionRule(MOTOR, "web", "frame_size", r"Frame size\s*(?:[|:]\s*)?(\d{3}[A-Z]?)"),
    ExtractionRule(MOTOR, "web", "protection_class", r"Protection\s*(?:[|:]\s*)?(IP\d+)"),
    ExtractionRule(MOTOR, "web", "insulation_class", r"Insulation\s*(?:[|:]\s*)?Class\s*([A-Z])"),
    ExtractionRule(MOTOR, "web", "mounting", r"Mounting\s*(?:[|:]\s*)?([A-Z0-9]+)"),
    ExtractionRule(MOTOR, "web", "weight", r"Weight\s*(?:[|:]\s*)?([\d.]+)\s*kg", unit="kg"),
    ExtractionRule(MOTOR, "ocr", "part_number", r"^([A-Z0-9\-]+)$", confidence=0.7, method="ocr_heuristic"),
    ExtractionRule(MOTOR, "ocr", "power_kw", r"^([\d.]+)\s*kW", unit="kW", confidence=0.7, method="ocr_heuristic"),
    ExtractionRule(MOTOR, "ocr", "rated_voltage", r"^(\d+)\s*V$", unit="V", confidence=0.7, method="ocr_heuristic"),
    ExtractionRule(MOTOR, "ocr", "rated_speed", r"^(\d+)\s*r/min", unit="rpm", confidence=0.7, method="ocr_heuristic"),
    ExtractionRule(MOTOR, "ocr", "protection_class", r"^(IP\d+)$", confidence=0.7, method="ocr_heuristic"),
    ExtractionRule(MOTOR, "ocr", "insulation_class", r"^([A-Z])$", confidence=0.6, method="ocr_heuristic"),
    ExtractionRule(MOTOR, "ocr", "mounting", r"^(B[0-9]+)$", confidence=0.6, method="ocr_heuristic"),
    ExtractionRule(VALVE, "pdf", "part_number", r"^Part no\.?\s+([A-Z0-9\-]+)"),
    ExtractionRule(VALVE, "pdf", "brand", r"^Brand\s+([A-Za-z]+)"),
    ExtractionRule(VALVE, "pdf", "connection_size", r"^DN \[mm\]\s+(\d+(?:[.,]\d+)?)", unit="mm"),
    ExtractionRule(VALVE, "pdf", "pressure_rating", r"^Pressure rating\s+([\d.]+)\s*(bar|psi|PSI)\b", unit_group=2),
    ExtractionRule(VALVE, "pdf", "body_material", r"^Body material\s+([a-z_ ]+)", step="strip"),
    ExtractionRule(VALVE, "pdf", "actuation", r"^Actuation\s+([a-z ]+)", step="strip"),
    ExtractionRule(VALVE, "pdf", "temperature_range_min", r"Operating temperature\s*([+-]?\d+)\s*°C\s+to\s+([+-]?\d+)\s*°C", unit="°C"),
    ExtractionRule(VALVE, "pdf", "temperature_range_max", r"Operating temperature\s*([+-]?\d+)\s*°C\s+to\s+([+-]?\d+)\s*°C", group=2, unit="°C"),
    ExtractionRule(VALVE, "pdf", "weight", r"^Weight\s+([\d.]+)\s*(kg|g|lb)", unit_group=2),
    ExtractionRule(VALVE, "web", "part_number", r"^(V[0-9A-Z\-]+)\b", confidence=0.85, method="llm_inference"),
    ExtractionRule(VALVE, "web", "connection_size", r"DN\s*(\d+(?:[.,]\d+)?)\s*mm", unit="mm"),
    ExtractionRule(VALVE, "web", "connection_size", r"Connection\s*[:| ]+([\d.]+)\s*in\b", unit="in", confidence=0.9),
    ExtractionRule(VALVE, "web", "pressure_rating", r"(?:PN|Pressure rating)[^\d]*?([\d.]+)\s*(bar|psi|PSI)\b", unit_group=2, confidence=0.9),
    ExtractionRule(VALVE, "web", "body_material", r"Body material\s*[:| ]+([A-Za-z_ ]+)", step="strip", confidence=0.9),
    ExtractionRule(VALVE, "web", "actuation", r"Actuation\s*[:| ]+([a-z ]+)", step="strip", confidence=0.9),
    ExtractionRule(VALVE, "web", "temperature_range_min", r"Operating temperature[^\n]*?([+-]?\d+)\s*°C\s+to\s+([+-]?\d+)\s*°C", unit="°C"),
    ExtractionRule(VALVE, "web", "temperature_range_max", r"Operating temperature[^\n]*?([+-]?\d+)\s*°C\s+to\s+([+-]?\d+)\s*°C", group=2, unit="°C"),
    ExtractionRule(VALVE, "web", "weight", r"Weight\s*[:| ]+([\d.]+)\s*(kg|g|lb)", unit_group=2),
    ExtractionRule(REDUCER, "pdf", "part_number", r"^Part no\.?\s+([A-Z0-9\-]+)"),
    ExtractionRule(REDUCER, "pdf", "brand", r"^Brand\s+([A-Za-z]+)"),
    ExtractionRule(REDUCER, "pdf", "ratio", r"^Ratio\s+([\d.]+)\s*:\s*1\b"),
    ExtractionRule(REDUCER, "pdf", "input_speed", r"^Input speed\s+([\d\s.,]+)\s*(r/min|rpm)", step="nospace", unit="rpm"),
    ExtractionRule(REDUCER, "pdf", "output_speed", r"^Output speed\s+([\d\s.,]+)\s*(r/min|rpm)", step="nospace", unit="rpm"),
    ExtractionRule(REDUCER, "pdf", "rated_torque", r"^Rated torque\s+([\d\s.,]+)\s*(Nm|N·m|ft-lb|lbf·ft)\b", step="nospace", unit_group=2),
    ExtractionRule(REDUCER, "pdf", "service_factor", r"^Service factor\s+([\d.]+)"),
    ExtractionRule(REDUCER, "pdf", "efficiency", r"^Efficiency\s+([\d.]+)\s*%", unit="%"),
    ExtractionRule(REDUCER, "pdf", "mounting", r"^Mounting\s+([A-Z0-9]+)"),
    ExtractionRule(REDUCER, "pdf", "protection_class", r"^Protection\s+(IP\d+)"),
    ExtractionRule(REDUCER, "pdf", "lubrication", r"^Lubrication\s+(oil|grease)"),
    ExtractionRule(REDUCER, "pdf", "weight", r"^Mass\s+([\d.]+)\s*(kg|g)", unit="kg"),
    ExtractionRule(REDUCER, "web", "part_number", r"^([A-Z0-9\-]+)\s+Gear (?:Reducer|Reduction)", confidence=0.85, method="llm_inference"),
    ExtractionRule(REDUCER, "web", "ratio", r"Ratio\s*(?:[|:]\s*)?([\d.]+)\s*:\s*1\b", confidence=0.9),
    ExtractionRule(REDUCER, "web", "input_speed", r"Input speed\s*(?:[|:]\s*)?([\d\s.,]+)\s*(rpm|r/min)", step="nospace", unit="rpm", confidence=0.9),
    ExtractionRule(REDUCER, "web", "output_speed", r"Output speed\s*(?:[|:]\s*)?([\d\s.,]+)\s*(rpm|r/min)", step="nospace", unit="rpm", confidence=0.9),
    ExtractionRule(REDUCER, "web", "rated_torque", r"(?:Rated torque|Torque rating)\s*(?:[|:]\s*)?([\d\s.,]+)\s*(Nm|N·m|ft-lb|lbf·ft)\b", step="nospace", unit_group=2, confidence=0.9),
    ExtractionRule(REDUCER, "web", "service_factor", r"Service factor\s*(?:[|:]\s*)?([\d.]+)", confidence=0.9),
    ExtractionRule(REDUCER, "web", "efficiency", r"Efficiency\s*(?:[|:]\s*)?([\d.]+)\s*%", unit="%", confidence=0.9),
    ExtractionRule(REDUCER, "web", "mounting", r"Mounting\s*(?:[|:]\s*)?([A-Z0-9]+)", confidence=0.9),
    ExtractionRule(REDUCER, "web", "protection_class", r"Protection\s*(?:[|:]\s*)?(IP\d+)", confidence=0.9),
    ExtractionRule(REDUCER, "web", "lubrication", r"Lubrication\s*(?:[|:]\s*)?(oil|grease)", confidence=0.9),
    ExtractionRule(REDUCER, "web", "weight", r"Weight\s*(?:[|:]\s*)?([\d.]+)\s*kg", unit="kg", confidence=0.9),
    ExtractionRule(REDUCER, "ocr", "part_number", r"^([A-Z0-9]{3,}[-/][A-Z0-9\-]+)$", confidence=0.7, method="ocr_heuristic"),
    ExtractionRule(REDUCER, "ocr", "ratio", r"^([\d.]+)\s*:\s*1$", confidence=0.7, method="ocr_heuristic"),
    ExtractionRule(REDUCER, "ocr", "rated_torque", r"^([\d\s.,]+)\s*N[·.]?m$", step="nospace", unit="Nm", confidence=0.7, method="ocr_heuristic"),
    ExtractionRule(REDUCER, "ocr", "protection_class", r"^(IP\d+)$", confidence=0.7, method="ocr_heuristic"),
    ExtractionRule(REDUCER, "ocr", "weight", r"^([\d.]+)\s*kg$", unit="kg", confidence=0.7, method="ocr_heuristic"),
)


def builtin() -> tuple[ExtractionRule, ...]:
    return RULES

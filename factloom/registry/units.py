"""Units: accepted spellings, conversion factors, and spellings of closed domains."""

from __future__ import annotations

# Canonical unit | spellings, which match without case
ALIASES = """
rpm | r/min, min-1, min⁻¹, r.p.m., rpm
kN | kn
N | n
lbf | lbf
kg | kg
g | g
mg | mg
lb | lb, lbs
oz | oz
mm | mm
cm | cm
m | m
in | in, inch, inches
ft | ft
°C | °c, c, degc, deg c
°F | °f, f, degf, deg f
K | k
bar | bar
mbar | mbar
psi | psi
MPa | mpa
kPa | kpa
Pa | pa
atm | atm
kW | kw
W | w
MW | mw
hp | hp
Nm | nm, n.m, n·m
kNm | knm
ft-lb | ft-lb, ft lb, lbf-ft, lbf·ft
in-lb | in-lb
V | v
kV | kv
mV | mv
A | a
mA | ma
kA | ka
Hz | hz
"""

# From | to | factor
FACTORS = """
N | kN | 0.001
kN | N | 1000.0
lbf | N | 4.44822
lbf | kN | 0.00444822
g | kg | 0.001
kg | g | 1000.0
mg | kg | 0.000001
lb | kg | 0.453592
oz | kg | 0.0283495
cm | mm | 10.0
m | mm | 1000.0
in | mm | 25.4
ft | mm | 304.8
mm | cm | 0.1
mm | m | 0.001
mm | in | 1.0 / 25.4
psi | bar | 0.0689476
bar | psi | 14.5038
MPa | bar | 10.0
bar | MPa | 0.1
kPa | bar | 0.01
bar | kPa | 100.0
Pa | bar | 0.00001
atm | bar | 1.01325
W | kW | 0.001
kW | W | 1000.0
MW | kW | 1000.0
hp | kW | 0.7457
kW | hp | 1.0 / 0.7457
ft-lb | Nm | 1.355818
in-lb | Nm | 0.1129848
kNm | Nm | 1000.0
Hz | rpm | 60.0
kV | V | 1000.0
mV | V | 0.001
mA | A | 0.001
kA | A | 1000.0
"""

# Field | spelling | canonical value
SYNONYMS = """
seal_type | contact seal | 2RS
seal_type | contact seal, rs1 on both sides | 2RS
seal_type | rs1 | RS
seal_type | rs | RS
seal_type | 2rs1 | 2RS
seal_type | 2rsh | 2RS
seal_type | 2rs | 2RS
seal_type | 2r5 | 2RS
seal_type | 2z | 2Z
seal_type | zz | 2Z
seal_type | 2ru | 2RU
seal_type | open | open
seal_type | no seal | open
clearance | c0 | C0
clearance | c2 | C2
clearance | cn | CN
clearance | normal | CN
clearance | c3 | C3
clearance | c4 | C4
clearance | c5 | C5
actuation | manual lever | manual
actuation | lever | manual
actuation | hand | manual
actuation | pneumatic actuator | pneumatic
actuation | air | pneumatic
actuation | electric actuator | electric
actuation | motorised | electric
actuation | motorized | electric
"""

TEMPERATURES = ("°C", "°F", "K")


def _rows(table: str) -> list[list[str]]:
    return [[c.strip() for c in line.split(" | ")] for line in table.strip().splitlines()]


def aliases() -> dict[str, str]:
    return {spelling: unit for unit, spellings in _rows(ALIASES) for spelling in spellings.split(", ")}


def factors() -> dict[tuple[str, str], float]:
    """Both directions: a stated factor holds, else one over that of the reverse pair."""
    stated = {}
    for a, b, factor in _rows(FACTORS):
        over, _, under = factor.partition("/")
        stated[a, b] = float(over) / float(under) if under else float(over)
    return {(b, a): 1.0 / f for (a, b), f in stated.items()} | stated


def synonyms() -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    for field, spelling, value in _rows(SYNONYMS):
        out.setdefault(field, {})[spelling] = value
    return out

"""Click-through curves and the effects of result pages, as data.

Fixed values: published figures that estimates must agree with, in percent by position.
"""

from __future__ import annotations

import math

COUNTRIES = {  # fixed values: clickstream by country, all devices, positions 1 to 20
    "US": (9.13, 5.07, 3.60, 2.61, 1.95, 1.46, 1.10, 0.93, 0.75, 0.66, 0.63, 0.58, 0.43, 0.44, 0.45, 0.53, 0.60, 0.75, 0.88, 0.93),
    "GB": (10.48, 6.05, 4.49, 3.15, 2.54, 1.96, 1.55, 1.32, 1.10, 0.98, 0.91, 0.74, 0.59, 0.64, 0.73, 0.90, 1.07, 1.29, 1.36, 1.47),
    "CA": (11.30, 5.93, 4.29, 3.31, 2.64, 1.95, 1.50, 1.27, 1.03, 0.95, 0.89, 0.86, 0.61, 0.64, 0.77, 0.92, 1.10, 1.25, 1.34, 1.39),
    "IN": (14.88, 8.22, 4.79, 3.10, 2.09, 1.52, 1.10, 0.95, 0.77, 0.70, 0.57, 0.50, 0.36, 0.41, 0.45, 0.63, 0.83, 1.14, 1.27, 1.34),
    "JP": (13.94, 7.52, 4.68, 3.91, 2.98, 2.42, 2.06, 1.78, 1.46, 1.32, 1.03, 1.00, 1.07, 1.34, 1.65, 2.19, 2.54, 2.83, 2.91, 2.85),
}
DEVICES = {  # fixed values: clickstream by device, positions 1 to 10
    "desktop": (8.17, 3.82, 2.43, 1.63, 1.11, 0.84, 0.67, 0.54, 0.52, 0.44),
    "mobile": (6.74, 3.41, 2.50, 1.71, 1.18, 0.89, 0.75, 0.64, 0.55, 0.48),
}
PANEL = {1: 27.6, 2: 15.8, 3: 11.0, 10: 2.76}  # fixed values: search console panel; 4 to 9 are declared gaps
CLEAN = {1: 39.8, 2: 18.7, 3: 10.2, 4: 7.2, 5: 5.1, 6: 4.4, 7: 3.0, 8: 2.1, 9: 1.9, 10: 1.6}  # fixed values: clean result pages
SERP_EFFECTS = {"ai_overview": (0.42, 0.98), "snippet_other": (0.65, 1.00), "snippet_own": (1.05, 1.60), "local_pack": (0.45, 0.75)}  # fixed values
SERP_FLOOR = 0.20
Z90 = 1.645

NUMBERED = lambda values: dict(enumerate(values, 1))
CURVES = {"clickstream": NUMBERED(COUNTRIES["US"]), "panel": PANEL, "clean": CLEAN}
BY_COUNTRY = {k: NUMBERED(v) for k, v in COUNTRIES.items()}


def all_curves() -> list[tuple[str, str, int, float]]:
    """(curve, variant, position, percent) of every published point."""
    rows = [("clickstream", c.lower(), p, v) for c, curve in BY_COUNTRY.items() for p, v in curve.items()]
    rows += [("clickstream", d, p, v) for d, curve in DEVICES.items() for p, v in NUMBERED(curve).items()]
    return rows + [("panel", "all", p, v) for p, v in PANEL.items()] + [("clean", "all", p, v) for p, v in CLEAN.items()]


def interpolate(curve: dict[int, float], position: float) -> float | None:
    """Log-log between neighbours; never beyond the last point."""
    low, high = max((p for p in curve if p <= position), default=None), min((p for p in curve if p >= position), default=None)
    if low is None or high is None:
        return None
    if low == high:
        return curve[low]
    share = math.log(position / low) / math.log(high / low)
    return math.exp(math.log(curve[low]) + share * math.log(curve[high] / curve[low]))


def typical_disagreement() -> float:
    """Geometric mean, over positions with two curves or more, of the largest over the smallest."""
    logs = []
    for position in range(1, 21):
        values = [v for v in (interpolate(c, position) for c in CURVES.values()) if v is not None]
        if len(values) > 1:
            logs.append(math.log(max(values) / min(values)))
    return math.exp(sum(logs) / len(logs))

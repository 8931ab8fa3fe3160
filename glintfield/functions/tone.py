"""Tone curves and colour ramps over spark.range(n)."""

from __future__ import annotations

from glintfield.functions.steps import Step

#: The stops of the teal ramp (offset, red, green, blue).
TEAL_STOPS = [(0.0, 0, 0, 0), (1 / 3, 45, 105, 103), (2 / 3, 172, 212, 205), (1.0, 255, 255, 255)]


def curve_steps(n: int, base: float = 10.0, k: float = 5.0) -> list[Step]:
    """All curves at x = i / (n - 1); base of the logarithmic ones, k of the asinh."""
    if n < 2 or base <= 1 or k <= 0:
        raise ValueError("curves need two points at least, a base above 1 and a k above 0")
    base, more, k = f"{float(base)!r}", f"{float(base) - 1!r}", f"{float(k)!r}"
    return [
        {"x": f"i/({n}-1.0)"},
        {
            "log_tone": f"ln(1.0+{more}*x)/ln({base})",
            "db_tone": f"ln(1.0+{more}*x*x)/ln({base})",
            "sqrt_tone": "sqrt(x)",
            "asinh_tone": f"asinh({k}*x)/asinh({k})",
        },
        {"loglog_tone": f"ln(1.0+{more}*log_tone)/ln({base})"},
        {"grey": "CAST(floor(255.0*log_tone) AS INT)"},
    ]


def ramp_channel(offset: str, stops: list[tuple], k: int) -> str:
    """Channel k of a piecewise linear ramp, cut to whole numbers."""
    text = f"{stops[-1][k]}.0"
    for (x0, *low), (x1, *high) in reversed(list(zip(stops, stops[1:]))):
        a, b = low[k - 1], high[k - 1]
        text = f"CASE WHEN {offset} <= {x1!r} THEN {a}.0+({offset}-{x0!r})/({x1!r}-{x0!r})*({b}.0-{a}.0) ELSE {text} END"
    return f"CAST(floor({text}) AS INT)"


def blended(t: str, first: tuple[int, ...], last: tuple[int, ...]) -> Step:
    """Red, green, blue and alpha at share t between two colours, cut to whole numbers; for the stops of a curve's ramp."""
    mixed = lambda a, b: f"{a}.0+{t}*({b - a}.0)"
    return {name: f"CAST((CASE WHEN {mixed(a, b)} < 0.0 THEN ceil({mixed(a, b)}) ELSE floor({mixed(a, b)}) END) AS INT)" for name, a, b in zip(("red", "green", "blue", "alpha"), first, last)}


def shader(t: str) -> list[Step]:
    """Grey levels of a tone in [0, 1]; any other value has none."""
    return [{"grey": f"(CASE WHEN {t} >= 0.0 AND {t} <= 1.0 THEN CAST(floor(255.0*{t}) AS INT) END)"}]

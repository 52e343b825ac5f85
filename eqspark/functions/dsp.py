"""Biquad arithmetic as SQL expressions, which Spark compiles and an oracle can run as they are.

A step is a select list over the columns of the steps before it. Filters have columns type, f, gain, q; grids have cw, sw, c2, s2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..schema import SAMPLE_RATE_HZ

RATE = f"{SAMPLE_RATE_HZ!r}e0"


def _pick(pk: str, ls: str, hs: str) -> str:
    return f"CASE type WHEN 'PK' THEN {pk} WHEN 'LS' THEN {ls} ELSE {hs} END"


#: Cookbook coefficients; a0 is 1 after the last step.
COEFFICIENTS = [
    f"power(10e0, gain / 40e0) AS amp, 2e0 * pi() * f / {RATE} AS w0",
    "cos(w0) AS k, sin(w0) / (2e0 * q) AS alpha",
    "2e0 * sqrt(amp) * alpha AS beta",
    ", ".join(
        [
            _pick("1e0 + alpha * amp", "amp * ((amp + 1e0) - (amp - 1e0) * k + beta)", "amp * ((amp + 1e0) + (amp - 1e0) * k + beta)") + " AS n0",
            _pick("-2e0 * k", "2e0 * amp * ((amp - 1e0) - (amp + 1e0) * k)", "-2e0 * amp * ((amp - 1e0) + (amp + 1e0) * k)") + " AS n1",
            _pick("1e0 - alpha * amp", "amp * ((amp + 1e0) - (amp - 1e0) * k - beta)", "amp * ((amp + 1e0) + (amp - 1e0) * k - beta)") + " AS n2",
            _pick("1e0 + alpha / amp", "amp + 1e0 + (amp - 1e0) * k + beta", "amp + 1e0 - (amp - 1e0) * k + beta") + " AS d0",
            _pick("-2e0 * k", "-2e0 * ((amp - 1e0) + (amp + 1e0) * k)", "2e0 * ((amp - 1e0) - (amp + 1e0) * k)") + " AS d1",
            _pick("1e0 - alpha / amp", "amp + 1e0 + (amp - 1e0) * k - beta", "amp + 1e0 - (amp - 1e0) * k - beta") + " AS d2",
        ]
    ),
    "n0 / d0 AS b0, n1 / d0 AS b1, n2 / d0 AS b2, d1 / d0 AS a1, d2 / d0 AS a2",
]
COEFFICIENT_NAMES = ["b0", "b1", "b2", "a1", "a2"]

#: Magnitude in dB from coefficients and a grid's sines, by real and imaginary parts.
MAGNITUDE = (
    "20e0 * log10(greatest(sqrt("
    "(power(b0 + b1 * cw + b2 * c2, 2) + power(-b1 * sw - b2 * s2, 2)) / "
    "(power(1e0 + a1 * cw + a2 * c2, 2) + power(-a1 * sw - a2 * s2, 2))), 1e-300))"
)
#: The same by the expansion of the squared parts in cosines; it differs from MAGNITUDE in the last bits.
MAGNITUDE_EXPANDED = (
    "10e0 * log10(greatest("
    "(b0 * b0 + b1 * b1 + b2 * b2 + 2e0 * (b0 * b1 + b1 * b2) * cw + 2e0 * b0 * b2 * c2) / "
    "(1e0 + a1 * a1 + a2 * a2 + 2e0 * (a1 + a1 * a2) * cw + 2e0 * a2 * c2), 1e-300))"
)
#: Sines of a grid's frequencies f.
GRID = [f"2e0 * pi() * f / {RATE} AS w", "cos(w) AS cw, sin(w) AS sw, cos(2e0 * w) AS c2, sin(2e0 * w) AS s2"]


def split_list(exprs: str) -> list[str]:
    """A select list at its commas outside brackets."""
    out, depth, last = [], 0, 0
    for at, c in enumerate(exprs):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(exprs[last:at])
            last = at + 1
    return [*out, exprs[last:]]


def apply_steps(df: DataFrame, steps: list[str]) -> DataFrame:
    for step in steps:
        df = df.selectExpr("*", *split_list(step))
    return df


def nested(source: str, steps: list[str]) -> str:
    """The steps as nested SQL over ``source`` (a table name or a bracketed query)."""
    for i, step in enumerate(steps):
        source = f"(SELECT *, {step} FROM {source} AS q{i})"
    return source


def with_coefficients(filters: DataFrame) -> DataFrame:
    """``filters`` with b0, b1, b2, a1, a2."""
    out = apply_steps(filters, COEFFICIENTS)
    return out.select(*filters.columns, *COEFFICIENT_NAMES)

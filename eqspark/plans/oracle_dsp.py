"""SQL for filter responses, written apart from the operators' own expressions: cookbook shelves as mirror images, magnitudes by the analog prototypes."""

from __future__ import annotations

from ..sources.bridge import grid_sql


def grid(name: str, n: int, per_octave: int) -> str:
    """A logarithmic grid (idx, f) from 20 Hz to 20 kHz."""
    return grid_sql(name, n, f"20e0 * power(2e0, idx / {per_octave}e0)", 20_000.0)


def coefficients(name: str, source: str, keep: str) -> str:
    """CTEs up to ``name``: ``keep`` columns of ``source`` (type, f, gain, q), fc and the normalized coefficients."""
    return f"""{name}_shape AS (
    SELECT {keep}, type, f AS fc, gain, q, exp(gain * ln(10e0) / 40) AS root, cos(f * pi() / 24000) AS turn, sin(f * pi() / 24000) / q / 2 AS width, CASE type WHEN 'LS' THEN 1 WHEN 'HS' THEN -1 END AS side FROM {source}),
{name}_raw AS (
    SELECT {keep}, type, fc, gain, q,
           CASE WHEN side IS NULL THEN 1 + width * root ELSE root * (root + 1 - side * (root - 1) * turn + 2 * sqrt(root) * width) END AS n0,
           CASE WHEN side IS NULL THEN -2 * turn ELSE 2 * side * root * (root - 1 - side * (root + 1) * turn) END AS n1,
           CASE WHEN side IS NULL THEN 1 - width * root ELSE root * (root + 1 - side * (root - 1) * turn - 2 * sqrt(root) * width) END AS n2,
           CASE WHEN side IS NULL THEN 1 + width / root ELSE root + 1 + side * (root - 1) * turn + 2 * sqrt(root) * width END AS d0,
           CASE WHEN side IS NULL THEN -2 * turn ELSE -2 * side * (root - 1 + side * (root + 1) * turn) END AS d1,
           CASE WHEN side IS NULL THEN 1 - width / root ELSE root + 1 + side * (root - 1) * turn - 2 * sqrt(root) * width END AS d2
    FROM {name}_shape),
{name} AS (SELECT {keep}, type, fc, gain, q, n0 / d0 AS b0, n1 / d0 AS b1, n2 / d0 AS b2, d1 / d0 AS a1, d2 / d0 AS a2 FROM {name}_raw)"""


def response(side: str = "") -> str:
    """dB of a filter (type, fc, gain, q, behind a prefix) at frequency g.f, by the analog prototype: the bilinear transform takes g.f to the ratio of two tangents."""
    kind, fc, gain, q = (f"{side}{c}" for c in ("type", "fc", "gain", "q"))
    x = f"pow(tan(g.f * pi() / 48000) / tan({fc} * pi() / 48000), 2)"
    amp = f"pow(10e0, {gain} / 40)"
    bell = f"(pow(1 - {x}, 2) + {x} * pow({amp} / {q}, 2)) / (pow(1 - {x}, 2) + {x} / pow({amp} * {q}, 2))"
    near, far = f"(pow({amp} - {x}, 2) + {x} * {amp} / pow({q}, 2))", f"(pow(1 - {amp} * {x}, 2) + {x} * {amp} / pow({q}, 2))"
    return f"10 * log10(CASE {kind} WHEN 'PK' THEN {bell} WHEN 'LS' THEN pow({amp}, 2) * {near} / {far} ELSE pow({amp}, 2) * {far} / {near} END)"


GRID61 = grid("g", 61, 6)
GRID958 = grid("g", 958, 96)
COEFS = coefficients("coefs", "filters", "preset_id, ordinal, enabled")
LEVELS = f"levels AS (SELECT coefs.*, g.idx, g.f, {response()} AS db FROM coefs, g)"
CASCADE = "cascade AS (SELECT preset_id, idx, any_value(f) AS f, coalesce(sum(db) FILTER (enabled), 0) AS db FROM levels GROUP BY preset_id, idx)"
#: Opposing filters meet first and then the grid, so that pairs alone have a row for each place.
PAIRS = f"""met AS (SELECT l.preset_id, l.ordinal AS a, r.ordinal AS b, l.type AS l_type, l.fc AS l_fc, l.gain AS l_gain, l.q AS l_q, r.type AS r_type, r.fc AS r_fc, r.gain AS r_gain, r.q AS r_q
         FROM coefs AS l JOIN coefs AS r USING (preset_id) WHERE l.enabled AND r.enabled AND l.ordinal < r.ordinal AND l.gain * r.gain < 0 AND abs(log2(l.fc / r.fc)) <= 1),
sums AS (SELECT preset_id, a, b, sum(abs(x * y)) AS ab, sum(x * x) AS aa, sum(y * y) AS bb, any_value(small) AS small, any_value(octaves) AS octaves
         FROM (SELECT preset_id, a, b, least(abs(l_gain), abs(r_gain)) AS small, abs(log2(l_fc / r_fc)) AS octaves, {response('l_')} AS x, {response('r_')} AS y FROM met, g) GROUP BY preset_id, a, b),
pairs AS (SELECT preset_id, a, b, coalesce(ab / nullif(sqrt(aa * bb), 0), 0) * (1 - octaves) * small / 15 AS score FROM sums)"""

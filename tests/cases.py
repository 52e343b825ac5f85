"""Published cases: wished filters, the cap, and what a fit must give."""

# Name, wished filters, cap of filters, the first fit's rmse, largest deviation, filters and preamp.
FIRST = [
    ("flat_identity", [], 10, 0.0, 0.0, [], 0.0),
    ("broad_bass_shelf", [("LS", 120, 6, 0.7)], 10, 0.0454, 0.0807, [("LS", 119, 5.9, 0.7)], -5.9),
    ("single_mid_peak", [("PK", 1000, 6, 2)], 10, 0.0613, 0.2904, [("PK", 82, -0.7, 0.15), ("PK", 1000, 5.7, 2.16), ("PK", 8666, -0.7, 0.18)], -5.4),
    ("vocal_multi_feature", [("PK", 300, -3, 1.2), ("PK", 1500, 5, 2), ("PK", 3500, -4, 2.5)], 10, 0.1252, 0.302, [("PK", 41, 1.1, 0.37), ("PK", 296, -2.4, 1.95), ("PK", 1494, 5.7, 1.62), ("PK", 3490, -3.5, 2.62), ("PK", 13554, 1.1, 0.28)], -5.7),
    ("irregular_treble", [("PK", 6000, 4, 3), ("PK", 9000, -5, 4), ("PK", 13000, 3, 2)], 10, 0.0575, 0.2282, [("PK", 6025, 4, 2.64), ("PK", 8990, -4.9, 3.47), ("PK", 12904, 3.2, 2.22)], -3.8),
    ("narrow_feature", [("PK", 2500, 8, 10)], 10, 0.1508, 1.791, [("PK", 2498, 6.2, 6.94)], -6.2),
    ("filter_budget", [("PK", 80, 4, 1.5), ("PK", 250, -4, 2), ("PK", 800, 5, 2), ("PK", 2500, -5, 2), ("PK", 7000, 4, 2)], 3, 1.1319, 3.4274, [("PK", 262, -4.4, 1.78), ("PK", 809, 3.5, 1.26), ("PK", 2392, -5.2, 1.56)], -3.1),
    ("quantization_sensitive", [("PK", 1234.56, 4.37, 1.37)], 10, 0.4075, 0.4974, [("PK", 1235, 4, 1.76)], -4.0),
    ("preamp_overlap", [("LS", 120, 5, 0.7), ("PK", 500, 4, 1), ("PK", 1500, 3, 1.5)], 10, 0.1491, 0.4844, [("LS", 82, 1, 0.7), ("PK", 203, -3, 0.94), ("PK", 493, 1.3, 2.67), ("PK", 1576, 2.2, 2.5), ("PK", 4688, -4.1, 0.25), ("HS", 12243, -3.3, 0.7)], -1.0),
    ("opposing_filters_pressure", [("PK", 1000, 8, 2), ("PK", 1300, -6, 2), ("PK", 3500, 4, 1.2)], 10, 0.0957, 0.3912, [("PK", 71, -0.7, 0.18), ("PK", 964, 6.4, 2.67), ("PK", 1358, -4.5, 2.41), ("PK", 3494, 3.5, 1.52), ("HS", 8409, -0.6, 0.7)], -5.3),
]
# Name, wished filters and cap of the cases that the second fit must solve (rmse at most 0.25 dB, no deviation beyond 0.75 dB).
SOLVABLE = [
    ("bass_mid_mix", [("LS", 120, 5, 0.7), ("PK", 700, -2.8, 1.4), ("PK", 2400, 3.2, 2.2)], 10),
    ("alternating_2_8k", [("PK", 2200, 3, 2.4), ("PK", 3300, -3.8, 3), ("PK", 4800, 3.4, 3.8), ("PK", 7100, -2.8, 3.2)], 10),
    ("dense_treble", [("PK", 6200, 2.6, 4), ("PK", 8100, -3.2, 5), ("PK", 10400, 2.5, 4.2), ("PK", 13600, -2.2, 3.5), ("PK", 17000, 1.6, 2.5)], 10),
    ("mixed_widths", [("LS", 95, 3, 0.7), ("PK", 450, -2, 0.8), ("PK", 1800, 4.5, 2), ("PK", 3900, -5, 7), ("HS", 11500, 2, 0.7)], 10),
    ("overlap", [("PK", 900, 2.5, 0.9), ("PK", 1400, -3, 1.2), ("PK", 2100, 3.5, 1.6), ("PK", 3100, -2.5, 2)], 10),
    ("near_budget", [("PK", 90, 2, 1.2), ("PK", 220, -2.4, 1.5), ("PK", 520, 2.8, 1.8), ("PK", 1200, -3, 2), ("PK", 2600, 3.2, 2.4), ("PK", 5200, -3, 2.8), ("PK", 9000, 2.5, 3), ("PK", 15000, -2, 2.5)], 8),
    ("quantization_sensitive", [("PK", 1235, 4, 1.76), ("PK", 4567, -2.3, 2.37)], 10),
    ("overcomplete_compress", [("LS", 110, 2.5, 0.7), ("PK", 500, -2.2, 0.9), ("PK", 1300, 3.5, 1.7), ("PK", 2600, -3.8, 2.5), ("PK", 5200, 3, 3.2), ("HS", 12000, -2, 0.7)], 6),
]


def wished_level(wished, anchor_hz: float | None = None):
    """(frequencies, level) of wished filters on the evaluation grid, 0 dB at the anchor if there is one."""
    import numpy as np

    from eqspark.operators.fitting.kernel import Grid
    from eqspark.operators.grids import evaluation_grid

    f = np.array(evaluation_grid())
    level = Grid(f).cascade([tuple(x) for x in wished])
    return f, level if anchor_hz is None else level - np.interp(np.log(anchor_hz), np.log(f), level)

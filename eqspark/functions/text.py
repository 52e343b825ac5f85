"""Names, labels and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILTER_LABELS = {"PK": "PK", "LS": "LSC", "HS": "HSC"}
#: Spelling of filter types in files, and what they mean.
TYPE_OF_LABEL = {"PK": "PK", "LS": "LS", "LSQ": "LS", "LSC": "LS", "HS": "HS", "HSQ": "HS", "HSC": "HS"}


def normal_zero(x: Column) -> Column:
    """-0 becomes 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def safe_filename(name: Column) -> Column:
    """Control characters and characters that file systems reserve become ``_``, each."""
    return F.regexp_replace(name, r"[\x00-\x1f\x7f<>:\"/\\|?*]", "_")


def filename_base(name: Column, fallback: str) -> Column:
    """The safe name, or ``fallback`` if nothing but underscores and spaces is left of it."""
    safe = safe_filename(name)
    return F.when(F.regexp_replace(safe, r"[_\s]+", "") == "", F.lit(fallback)).otherwise(safe)


def curve_base(name: Column, fallback: str = "curve") -> Column:
    return filename_base(F.regexp_replace(name, r"(?i)\.(txt|csv)$", ""), fallback)


def filter_base(source: Column, target: Column | None = None) -> Column:
    """``source - [target]``, or ``source - [EQ]``."""
    name = F.regexp_replace(source, r"(?i)\.(txt|csv)$", "")
    other = F.lit("EQ") if target is None else F.coalesce(F.regexp_replace(target, r"(?i)\.(txt|csv)$", ""), F.lit("EQ"))
    return filename_base(F.concat(name, F.lit(" - ["), other, F.lit("]")), "filters")


def preset_name(name: Column) -> Column:
    """Control characters become spaces, runs of white space one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"[\x00-\x1f\x7f]", " "), r"\s+", " "))


def to_long_type(kind: Column) -> Column:
    return F.when(kind == "LS", "LSQ").when(kind == "HS", "HSQ").otherwise(kind)


def from_long_type(kind: Column) -> Column:
    return F.when(kind == "LSQ", "LS").when(kind == "HSQ", "HS").otherwise(kind)


def equalized_name(name: Column) -> Column:
    return F.concat(name, F.lit(" EQ"))


def elapsed(ms: Column) -> Column:
    """mm:ss of whole seconds."""
    s = F.floor(ms / 1000).cast("long")
    two = lambda c: F.when(F.length(c.cast("string")) < 2, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    return F.concat(two(F.floor(s / 60).cast("long")), F.lit(":"), two(s % 60))


def shortened(x: Column, places: int) -> Column:
    """Fixed digits without needless zeros."""
    return F.regexp_replace(F.regexp_replace(fixed(x, places), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def number_text(x: Column) -> Column:
    """A number without a needless fraction."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


def snapshot_frequency(f: Column) -> Column:
    return F.when(f < 1000, F.concat(number_text(f), F.lit(" Hz"))).otherwise(F.concat(shortened(f / 1000, 1), F.lit("k Hz")))


def snapshot_gain(gain: Column) -> Column:
    return F.concat(F.when(gain >= 0, "+").otherwise(""), fixed(gain, 1, True), F.lit(" dB"))


def snapshot_summary(filters: Column, preamp: Column) -> Column:
    """The first filter, how many more there are, and the preamp."""
    tail = F.concat(F.lit("preamp "), fixed(preamp, 1, True), F.lit(" dB"))
    first, more = F.get(filters, F.lit(0)), F.size(filters) - 1
    return F.when(F.size(filters) == 0, F.concat(F.lit("no bands, "), tail)).otherwise(F.concat(first["type"], F.lit(" "), snapshot_frequency(first["f"]), F.lit(" "), snapshot_gain(first["gain"]), F.when(more > 0, F.concat(F.lit(" +"), more)).otherwise(""), F.lit(", "), tail))


def graph_frequency(f: Column) -> Column:
    return F.when(f >= 1000, F.concat(fixed(f / 1000, 2), F.lit(" kHz"))).otherwise(F.concat(fixed(f, 0), F.lit(" Hz")))


def graph_tick(f: Column) -> Column:
    return F.when(f == 20, "20Hz").when(f == 20_000, "20kHz").when(f >= 1000, F.concat(number_text(f / 1000), F.lit("k"))).otherwise(number_text(f))


def display_db(db: Column) -> Column:
    return F.coalesce(F.concat(fixed(db, 2, True), F.lit(" dB")), F.lit("--"))


def display_frequency(f: Column) -> Column:
    return F.coalesce(F.when(f >= 1000, F.concat(shortened(f / 1000, 2), F.lit(" kHz"))).otherwise(F.concat(shortened(f, 2), F.lit(" Hz"))), F.lit("--"))


def split_depth(filter_id: Column) -> Column:
    """How often ``-split-`` occurs."""
    return F.size(F.split(filter_id, "-split-")) - 1


def linear_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def octave_distance(a: Column, b: Column) -> Column:
    return F.abs(F.log2(a / b))


def working_filters(n: Column) -> Column:
    """How many filters a search may hold for a cap of n."""
    return F.when(n == 0, 0).otherwise(F.least(F.lit(64), n + F.greatest(F.lit(4), F.ceil(n / 2)))).cast("int")


def public_error(category: Column, message: Column) -> Column:
    """Messages that may be shown; others are general."""
    return F.when(category.isin("validation", "optimization", "numeric"), message).otherwise(F.lit("the fit failed"))


def fixed(x: Column, places: int, keep_sign: bool = False) -> Column:
    """The decimal text of a double with ``places`` digits, halves of the exact binary value away from zero.

    Casting to a wide decimal goes through the shortest text of the double, so near halves are decided by the difference to the
    rounded value, which is exact there. ``keep_sign`` leaves the sign of what rounds to zero.
    """
    scale = float(10**places)
    a = F.abs(x)
    low = F.floor(a * scale)
    # which side of the half: compare the exact doubles a and (low + 0.5) / scale by an error-free product
    whole = F.when(_above_half(a, low, scale), low + 1).otherwise(low).cast("long")
    digits = F.format_string(f"%d.%0{places}d", F.floor(whole / int(scale)).cast("long"), (whole % int(scale)).cast("long")) if places else whole.cast("string")
    negative = (x < 0) & ((whole > 0) | F.lit(keep_sign))
    return F.concat(F.when(negative, "-").otherwise(""), digits)


def _above_half(a: Column, low: Column, scale: float) -> Column:
    """a * scale >= low + 0.5 in exact arithmetic: the product's rounding error is recovered by splitting (Dekker)."""
    p = a * scale
    big = a * 134217729.0
    hi = big - (big - a)
    lo = a - hi
    s_big = scale * 134217729.0
    s_hi = s_big - (s_big - scale)
    s_lo = scale - s_hi
    error = lo * s_lo - (((p - hi * s_hi) - lo * s_hi) - hi * s_lo)
    return (p - (low + 0.5)) + error >= 0

"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds in a unit of time.
UNIT_S = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
MISSING = ("", "nan", "na", "n/a", "null")


def r6(c: Column) -> Column:
    """Rounded to 6 places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def normalise_key(c: Column) -> Column:
    """ASCII letters and digits in lower case; each run of other characters is one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")


def to_seconds(c: Column, unit: Column | str) -> Column:
    u = F.lit(unit) if isinstance(unit, str) else unit
    factor = F.lit(None).cast("double")
    for name, s in UNIT_S.items():
        factor = F.when(u == name, F.lit(s)).otherwise(factor)
    return c * factor


def cell_number(c: Column) -> Column:
    """A cell's number: NaN where it is missing or can't be read."""
    t = F.trim(c)
    number = F.when(t.rlike(NUMBER), t.try_cast("double")).when(F.lower(t).isin("inf", "+inf", "infinity"), float("inf")).when(F.lower(t).isin("-inf", "-infinity"), float("-inf"))
    return F.coalesce(number, F.lit(float("nan")))


def cell_unreadable(c: Column) -> Column:
    t = F.trim(c)
    return ~F.lower(t).isin(*MISSING) & ~t.rlike(NUMBER) & ~F.lower(t).rlike("^[+-]?inf(inity)?$")


def cell_text(c: Column) -> Column:
    """A number as a cell: whole ones without a fraction, NaN and null empty."""
    whole = (c == F.rint(c)) & (F.abs(c) < 1e15)
    return F.when(c.isNull() | F.isnan(c), "").when(whole, F.when(c != 0, c).otherwise(0).cast("long").cast("string")).otherwise(c.cast("string"))


def quoted(c: Column, sep: str = ",") -> Column:
    """A text as a cell: in quotes, with "" for each quote inside, where it would otherwise be read as something else."""
    return F.when(c.rlike(r'["\r\n' + "\\" + sep + r"]|^\s|\s$|^#"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def shortest_time(seconds: Column, factor: float) -> Column:
    """Seconds in a unit of `factor` seconds, with the fewest decimals (17 at most) that give the same seconds again."""
    v = seconds / factor
    tries = [F.when(F.format_string(f"%.{k}f", v).cast("double") * factor == seconds, F.format_string(f"%.{k}f", v)) for k in range(18)]
    return F.when(~finite(seconds), None).otherwise(F.coalesce(*tries, v.cast("string")))


#: Least and greatest value of whole number types.
RANGES = {"u8": (0, 255), "i16": (-(1 << 15), (1 << 15) - 1), "i32": (-(1 << 31), (1 << 31) - 1)}


def narrowed(c: Column, dtype: str | None) -> Column:
    """A number as another type: whole ones rounded, held inside their range, NaN as 0; f32 and f64 as they are."""
    if dtype in (None, "f64"):
        return c
    if dtype == "f32":
        return c.cast("float").cast("double")
    lo, hi = RANGES[dtype]
    return F.when(c.isNull(), None).when(F.isnan(c), 0.0).otherwise(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.round(c))))


def scaled(raw: Column, scale: Column | float = 1.0, offset: Column | float = 0.0) -> Column:
    """The value that a stored whole number stands for."""
    return raw * scale + offset


def magnitude(re: Column, im: Column) -> Column:
    return F.hypot(re, im)


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def decibels(c: Column, floor: float = -300.0) -> Column:
    return F.when(c > 0, F.greatest(20 * F.log10(F.when(c > 0, c)), F.lit(floor))).otherwise(floor)


def iso_time(c: Column) -> Column:
    """A timestamp as ISO 8601 in UTC, to the microsecond; the session's time zone must be UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def from_iso(c: Column) -> Column:
    """The timestamp of an ISO 8601 text; null where there is none."""
    return F.try_to_timestamp(c)

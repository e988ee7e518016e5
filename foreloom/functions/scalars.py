"""Scalar, array, date and cleaning functions, all built from JVM-side functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreloom.functions.expressions import ColumnLike, as_column

# The largest power of ten that is turned back, both signs.
LOG_LIMIT = 308.0


def log10p1(x: ColumnLike) -> Column:
    return F.log10(as_column(x) + F.lit(1.0))


def inv_log10p1(x: ColumnLike) -> Column:
    """10**x - 1; infinite outside the limits; NULL stays NULL."""
    c = as_column(x)
    return (
        F.when(c.isNull(), F.lit(None).cast("double"))
        .when(F.abs(c) <= LOG_LIMIT, F.pow(F.lit(10.0), c) - 1.0)
        .otherwise(F.lit(float("inf")))
    )


def date_add_steps(last: ColumnLike, step: ColumnLike, i: ColumnLike) -> Column:
    """``last + i * step`` with an interval column or literal."""
    return as_column(last) + as_column(step) * as_column(i)


def seconds_interval(seconds: ColumnLike) -> Column:
    zero = F.lit(0)
    return F.make_dt_interval(zero, zero, zero, as_column(seconds).cast("decimal(18,6)"))


def micros(ts: ColumnLike) -> Column:
    """Microseconds since 1970 of a timestamp, the same in every session time zone."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", zero, as_column(ts).cast("timestamp_ntz"))


def date_from_index(start: ColumnLike, index: ColumnLike, unit_seconds: int = 1) -> Column:
    return as_column(start) + seconds_interval(as_column(index) * F.lit(unit_seconds))


# Names of series frequencies and the step that each stands for.
FREQUENCY_UNITS = {
    "seconds": ("second", 1),
    "minutely": ("minute", 1),
    "minutes": ("minute", 1),
    "hourly": ("hour", 1),
    "hours": ("hour", 1),
    "daily": ("day", 1),
    "days": ("day", 1),
    "weekly": ("day", 7),
    "weeks": ("day", 7),
    "monthly": ("month", 1),
    "months": ("month", 1),
    "quarterly": ("month", 3),
    "quarters": ("month", 3),
    "yearly": ("month", 12),
    "years": ("month", 12),
}
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def freq_to_interval(name: str) -> str:
    """Interval text of a frequency name such as ``10_minutes`` or ``half_hourly``."""
    *multiple, unit = name.split("_")
    if len(multiple) > 1 or unit not in FREQUENCY_UNITS:
        raise ValueError(f"no frequency of this name: {name}")
    base, count = FREQUENCY_UNITS[unit]
    factor = multiple[0] if multiple else "1"
    if factor == "half":
        if base == "month":
            if count % 2:
                raise ValueError(f"no frequency of this name: {name}")
            return f"{count // 2} months"
        return f"{UNIT_SECONDS[base] * count // 2} seconds" if base != "second" else "0.5 seconds"
    if not factor.isdigit():
        raise ValueError(f"no frequency of this name: {name}")
    return f"{int(factor) * count} {base}s"


def _freq_parts(freq: ColumnLike) -> tuple[Column, Column, Column]:
    """(factor, seconds of a unit, months of a unit) of a column of names; one of the units is NULL."""
    c = as_column(freq)
    parts = F.split(c, "_")
    unit, head = F.element_at(parts, -1), F.when(F.size(parts) == 2, parts[0])
    factor = F.when(F.size(parts) == 1, F.lit(1.0)).when(head == "half", F.lit(0.5)).otherwise(head.try_cast("double"))
    units = {n: float(count if base == "month" else UNIT_SECONDS[base] * count) for n, (base, count) in FREQUENCY_UNITS.items()}
    size = F.element_at(F.create_map(*[F.lit(x) for pair in units.items() for x in pair]), unit)
    calendar = unit.isin([n for n, (base, _) in FREQUENCY_UNITS.items() if base == "month"])
    wrong = F.raise_error(F.concat(F.lit("no frequency of this name: "), c)).cast("double")
    known = F.when(c.isNull(), F.lit(None).cast("double")).when(size.isNull() | factor.isNull() | (F.size(parts) > 2), wrong).otherwise(factor)
    return known, F.when(~calendar, size), F.when(calendar, size)


def freq_interval_column(freq: ColumnLike) -> Column:
    """The step of a column of names in seconds, NULL for calendar steps; a name that is none is an error."""
    factor, seconds, _ = _freq_parts(freq)
    return factor * seconds


def freq_months_column(freq: ColumnLike) -> Column:
    """The calendar step of a column of names in months, NULL for other steps; a name that is none is an error."""
    factor, _, months = _freq_parts(freq)
    return (factor * months).cast("int")


def add_frequency(time: ColumnLike, freq: ColumnLike, steps: ColumnLike) -> Column:
    """A time some steps of its frequency later, by the calendar where the step is one of months."""
    t, n = as_column(time), as_column(steps)
    later = t + F.make_dt_interval(secs=(freq_interval_column(freq) * n).cast("decimal(18,6)"))
    return F.coalesce(t + F.make_ym_interval(months=(freq_months_column(freq) * n).cast("int")), later)


def reverse_array(a: ColumnLike) -> Column:
    return F.coalesce(F.reverse(as_column(a)), F.array().cast("array<double>"))


def shift_in(a: ColumnLike, x: ColumnLike) -> Column:
    """Put a value in front and drop the last one; the length stays."""
    c = as_column(a)
    return F.slice(F.concat(F.array(as_column(x)), c), 1, F.size(c))


def array_norm(*arrays: ColumnLike) -> Column:
    joined = F.concat(*[as_column(a) for a in arrays])
    return F.sqrt(F.aggregate(joined, F.lit(0.0), lambda s, x: s + x * x))


def array_scale(a: ColumnLike, factor: ColumnLike) -> Column:
    f = as_column(factor)
    return F.transform(as_column(a), lambda x: x * f)


def random_feature(seed: int, *keys: ColumnLike, top: int = 1000) -> Column:
    """A whole number in 1..top; from the keys when given, so that it is repeatable."""
    if not keys:
        return F.floor(F.rand(seed) * top + 1).cast("int")
    return (F.pmod(F.xxhash64(F.lit(seed), *[as_column(k) for k in keys]), F.lit(top)) + 1).cast("int")


def clean_numeric(c: ColumnLike) -> Column:
    """Infinities, NaN, the text NULL and other non-numbers become NULL."""
    x = as_column(c).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def json_arg(doc: ColumnLike, key: str, default: bool = False) -> Column:
    """Value of a key as a boolean."""
    text = F.get_json_object(as_column(doc), f"$.{key}")
    return F.coalesce(text.try_cast("boolean"), F.lit(default))


def synthetic_target(sales: ColumnLike, oil: ColumnLike, store: ColumnLike, day: ColumnLike, trans: ColumnLike) -> Column:
    """The star schema's made-up target; missing parts count as 0."""

    def part(c):
        return F.coalesce(c, F.lit(0.0))

    def logged(c):
        return part(F.log10(F.abs(as_column(c).cast("double")) + 1.0))

    return (
        logged(sales)
        + logged(oil)
        - 10.0 * part(as_column(store).cast("double"))
        - 10.0 * F.dayofyear(as_column(day))
        + F.pow(part(as_column(trans).cast("double")), F.lit(2.0))
    )


def rename_reserved(df: DataFrame, reserved: tuple[str, ...] = ("s", "c", "rowid"), prefix: str = "fl_"):
    """Rename columns that clash with working names; returns the frame and old -> new."""
    names = {}
    taken = set(df.columns)
    for c in df.columns:
        if c in reserved:
            new = prefix + c
            while new in taken:
                new = prefix + new
            names[c] = new
            taken.add(new)
    return df.withColumnsRenamed(names), names

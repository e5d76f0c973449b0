"""Values of claims: amounts, times, intervals and their windows, as column expressions over whole tables.

Amounts keep the author's text and are compared as double windows [v - p/2, v + p/2). Times are text with a precision; their
windows are epoch seconds as doubles, so years of any length fit. Precisions of times, from fine to coarse: s min h d m y 10y
100y 1ky 10ky 100ky 1My 10My 100My 1Gy, and ms us ns below a second.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Seconds of the precisions below a day, years of those above a month.
SECONDS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "min": 60.0, "h": 3600.0}
YEARS = {"y": 1, "10y": 10, "100y": 100, "1ky": 10**3, "10ky": 10**4, "100ky": 10**5, "1My": 10**6, "10My": 10**7, "100My": 10**8, "1Gy": 10**9}
PRECISIONS = [*SECONDS, "d", "m", *YEARS]
#: Fixed value: the largest magnitude of an indexed bound, for interval ends that are none.
LARGEST = 1.7976931348623157e308


def amount_value(raw: Column) -> Column:
    """The double of a decimal text; a comma is a decimal point. Null for anything else."""
    text = F.regexp_replace(F.trim(raw), ",", ".")
    return F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def parse_amounts(df: DataFrame, raw: str = "raw", precision: str = "precision") -> DataFrame:
    """df with value (rounded to a multiple of its precision) and error: null, 'not a number', 'bad precision', 'not a multiple'."""
    v, p = amount_value(F.col(raw)), F.col(precision)
    steps = F.round(v / p)
    error = (
        F.when(v.isNull(), "not a number")
        .when(p.isNull() | (p <= 0) | F.isnan(p), "bad precision")
        .when(F.abs(v - steps * p) > F.greatest(F.abs(v), p) * 1e-9, "not a multiple")
    )
    return df.withColumn("error", error).withColumn("value", F.when(F.col("error").isNull(), steps * p))


def amount_window(v: Column, p: Column) -> tuple[Column, Column, Column]:
    """lo, hi, hi_incl. A window too narrow for doubles collapses to the closed point."""
    lo, hi = v - p / 2, v + p / 2
    flat = lo >= hi
    return F.when(flat, v).otherwise(lo), F.when(flat, v).otherwise(hi), flat


def amount_windows(df: DataFrame, value: str = "value", precision: str = "precision") -> DataFrame:
    lo, hi, incl = amount_window(F.col(value), F.col(precision))
    return df.withColumns({"lo": lo, "hi": hi, "hi_incl": incl})


def detect_precision(raw: Column) -> Column:
    """The precision that the decimals of an amount's text show: 10 ** -decimals."""
    decimals = F.length(F.regexp_extract(F.regexp_replace(raw, ",", "."), r"\.(\d+)", 1))
    return F.pow(F.lit(10.0), -decimals.cast("double"))


def format_amount(value: Column, precision: Column) -> Column:
    """The value with as many decimals as the precision has."""
    decimals = F.greatest(F.lit(0), F.ceil(-F.log10(precision) - 1e-9)).cast("int")
    steps = F.round(value / precision) * precision
    return _decimals(steps, decimals)


def _decimals(v: Column, n: Column) -> Column:
    out = F.format_string("%.0f", v)
    for i in range(1, 13):
        out = F.when(n == i, F.format_string(f"%.{i}f", v)).otherwise(out)
    return out


_TIME = re.compile(r"([+-]?\d{4,})(?:-(\d{2}))?(?:-(\d{2}))?(?:[T ](\d{2}))?(?::(\d{2}))?(?::(\d{2}(?:\.\d+)?))?Z?")
_MONTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def _days(year: int, month: int, day: int = 1) -> int:
    """Days from 1970-01-01 in the proleptic Gregorian calendar, for years of any size."""
    past = year - 1
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    return past * 365 + past // 4 - past // 100 + past // 400 + sum(_MONTHS[: month - 1]) + (leap and month > 2) + day - 719_163


@functools.lru_cache(100_000)
def _time(raw: str | None, precision: str | None) -> tuple:
    """error, seconds of the start as written, lo (start of the step that holds it), hi (start of the next), hi_incl."""
    found = _TIME.fullmatch((raw or "").strip())
    fail = lambda error: (error, None, None, None, None)
    if not found:
        return fail("not a time")
    if precision not in PRECISIONS:
        return fail("bad precision")
    rank, given = PRECISIONS.index(precision), dict(zip(("m", "d", "h", "min", "s"), found.groups()[1:]))
    year, value = int(found[1]), {k: float(v) if k == "s" else int(v) for k, v in given.items() if v is not None}
    month, day = value.get("m") or 1, value.get("d") or 1
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    if month > 12 or day > _MONTHS[month - 1] + (leap and month == 2) or value.get("h", 0) > 23 or value.get("min", 0) > 59 or value.get("s", 0) >= 60:
        return fail("out of range")
    if any(rank <= PRECISIONS.index(k) and k not in value for k in given):
        return fail("too few parts")
    if any(rank > PRECISIONS.index(k) and value.get(k, 0) > (k in "md") for k in given):
        return fail("too many parts")
    seconds = float(_days(year, month, day) * 86_400 + value.get("h", 0) * 3_600 + value.get("min", 0) * 60) + value.get("s", 0.0)
    if precision in YEARS:
        n = YEARS[precision]
        lo, hi = (float(_days(y, 1) * 86_400) for y in (year // n * n, year // n * n + n))
    elif precision == "m":
        lo, hi = (float(_days(year + m // 12, m % 12 + 1) * 86_400) for m in (month - 1, month))
    else:
        lo, hi = seconds, seconds + (86_400.0 if precision == "d" else SECONDS[precision])
    hi = max(hi, lo + abs(lo) * 2.0**-52)
    return None, seconds, lo, hi, lo >= hi


_FACTS = T.StructType().add("error", "string").add("seconds", "double").add("lo", "double").add("hi", "double").add("hi_incl", "boolean")


@F.pandas_udf(_FACTS)
def time_facts(raw: pd.Series, precision: pd.Series) -> pd.DataFrame:
    """Calendar arithmetic on years of any size; as column expressions it outgrows code generation. Equal texts are worked out once."""
    return pd.DataFrame([_time(r, p) for r, p in zip(raw, precision)], columns=["error", "seconds", "lo", "hi", "hi_incl"])


def day_start(raw: Column, precision: Column) -> Column:
    """Seconds of a time that is written as a plain day of four-digit years, null for all others: those need time_facts()."""
    plain = (precision == "d") & raw.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return F.when(plain, F.unix_date(raw.try_cast("date")) * F.lit(86_400.0))


def parse_times(df: DataFrame, raw: str = "raw", precision: str = "time_precision") -> DataFrame:
    """df with seconds (of the start) and error. Parts finer than the precision must be absent, 00 or the first day or month."""
    return df.withColumn("__f", time_facts(F.col(raw), F.col(precision))).withColumns({"error": F.col("__f.error"), "seconds": F.col("__f.seconds")}).drop("__f")


def time_windows(df: DataFrame, raw: str = "raw", precision: str = "time_precision") -> DataFrame:
    """df with lo (start), hi (start of the next step) and hi_incl; widened by one unit in the last place where doubles need it."""
    out = df.withColumn("__f", time_facts(F.col(raw), F.col(precision)))
    return out.withColumns({c: F.col(f"__f.{c}") for c in ("error", "seconds", "lo", "hi", "hi_incl")}).drop("__f")


def time_starts(df: DataFrame, raw: str = "raw", precision: str = "time_precision") -> DataFrame:
    """df with lo, the start of its time; plain days stay out of Python. What is no time has a null."""
    day = day_start(F.col(raw), F.col(precision))
    rest = time_windows(df.where(day.isNull()), raw, precision).drop("error", "seconds", "hi", "hi_incl")
    return df.where(day.isNotNull()).withColumn("lo", day).unionByName(rest)


def with_civil(df: DataFrame, seconds: str) -> DataFrame:
    """df with __y, __m, __d (civil date) and __r (seconds of the day), a few columns at a time so that no expression grows."""
    df = df.withColumn("__z", F.floor(F.col(seconds) / 86400).cast("bigint"))
    df = df.withColumns({"__r": F.floor(F.col(seconds) - F.col("__z") * 86400).cast("bigint"), "__era": F.floor((F.col("__z") + 719468) / 146097)})
    df = df.withColumn("__doe", F.col("__z") + 719468 - F.col("__era") * 146097)
    df = df.withColumn("__yoe", F.expr("(__doe - __doe DIV 1460 + __doe DIV 36524 - __doe DIV 146096) DIV 365"))
    df = df.withColumn("__doy", F.expr("__doe - (365 * __yoe + __yoe DIV 4 - __yoe DIV 100)"))
    df = df.withColumn("__mp", F.expr("(5 * __doy + 2) DIV 153"))
    df = df.withColumns({"__m": F.expr("IF(__mp < 10, __mp + 3, __mp - 9)"), "__d": F.expr("__doy - (153 * __mp + 2) DIV 5 + 1")})
    return df.withColumn("__y", F.expr("__yoe + __era * 400 + IF(__m <= 2, 1, 0)")).drop("__z", "__era", "__doe", "__yoe", "__doy", "__mp")


def format_times(df: DataFrame, seconds: str, precisions: dict[str, str]) -> DataFrame:
    """df with a text column for each name: precision. Parts finer than the precision are left out, years have four digits at least."""
    out = with_civil(df, seconds)
    size = F.abs("__y").cast("string")
    out = out.withColumn("__year", F.concat(F.when(F.col("__y") < 0, "-").otherwise(""), F.when(F.length(size) < 4, F.lpad(size, 4, "0")).otherwise(size)))
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    parts = {"m": [two(F.col("__m"))], "d": [F.lit("-"), two(F.col("__d"))], "h": [F.lit("T"), two(F.expr("__r DIV 3600"))], "min": [F.lit(":"), two(F.expr("__r DIV 60 % 60"))], "s": [F.lit(":"), two(F.expr("__r % 60"))]}

    def text(precision: str):
        if precision in YEARS:
            return F.col("__year")
        have = list(parts)[: list(parts).index("s" if precision in ("ms", "us", "ns") else precision) + 1]
        return F.concat(F.col("__year"), F.lit("-"), *[c for name in have for c in parts[name]])

    return out.withColumns({name: text(p) for name, p in precisions.items()}).drop("__y", "__m", "__d", "__r", "__year")


def with_time_precision(df: DataFrame, seconds: str = "lo", name: str = "precision") -> DataFrame:
    """df with the coarsest precision that a start has by itself: 1Gy to 10y for round years, y, m, d, h, min, s."""
    out = F.when(F.col(seconds) % 60 != 0, "s").when(F.col(seconds) % 3600 != 0, "min").when(F.col(seconds) % 86400 != 0, "h").when(F.col("__d") != 1, "d").when(F.col("__m") != 1, "m")
    for step, n in reversed(list(YEARS.items())):
        out = out.when(F.col("__y") % n == 0, step)
    return with_civil(df, seconds).withColumn(name, out).drop("__y", "__m", "__d", "__r")


def amount_precision_of(v: Column) -> Column:
    """The largest power of ten between 1e-9 and 1e9 that a value is a multiple of."""
    out = None
    for i in range(9, -10, -1):
        step = 10.0**i
        fits = F.abs(F.round(v / step) * step - v) <= F.greatest(F.abs(v), F.lit(1.0)) * 1e-12
        out = F.when(fits, F.lit(step)) if out is None else out.when(fits, F.lit(step))
    return out.otherwise(F.lit(1e-9))


def precision_profile(df: DataFrame, by: str = "prop", value: str = "lo", kind: str = "amount") -> DataFrame:
    """(by, precision, n): values by the precision they seem to have."""
    rows = df.withColumn("precision", amount_precision_of(F.col(value))) if kind == "amount" else with_time_precision(df, value)
    return rows.groupBy(by, "precision").agg(F.count("*").alias("n"))


def step_down(v: Column, span: Column) -> Column:
    """A histogram's start when the least value is itself an end: v less one step. The step is the precision that v seems to
    have, but at most the largest power of ten that is not over a fifth of the span's own power (so that one bin isn't empty)."""
    own = amount_precision_of(v)
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(span, F.lit(1e-300)))))
    return v - F.least(F.when(v == 0, scale).otherwise(own), scale)


def interval_windows(df: DataFrame) -> DataFrame:
    """Windows of intervals with ends from_v, from_p, from_open, from_state and to_v, to_p, to_open, to_state (state: null,
    'unknown' or 'none'; open ends exclude the end's own window). Decreasing intervals are swapped. One unknown end gives the
    window of the known one; an end that is none reaches to the largest double; two unknown ends give an unknown record, as does an
    unknown end beside one that is none. Of two ends without a state, one that lacks its value is unknown if the other has one; a value
    that lacks otherwise leaves its bound null."""
    stated = F.col("from_state").isNull() & F.col("to_state").isNull()
    swap = stated & (F.col("from_v") > F.col("to_v"))
    f = {k: F.when(swap, F.col(f"to_{k}")).otherwise(F.col(f"from_{k}")) for k in ("v", "p", "open")}
    t = {k: F.when(swap, F.col(f"from_{k}")).otherwise(F.col(f"to_{k}")) for k in ("v", "p", "open")}
    lo = F.when(f["open"], f["v"] + f["p"] / 2).otherwise(f["v"] - f["p"] / 2)
    hi = F.when(t["open"], t["v"] - t["p"] / 2).otherwise(t["v"] + t["p"] / 2)
    state = lambda s, o: F.when(stated & F.col(f"{s}_v").isNull() & F.col(f"{o}_v").isNotNull(), "unknown").otherwise(F.coalesce(f"{s}_state", F.lit("")))
    fs, ts = state("from", "to"), state("to", "from")
    unknown = (fs == "unknown") & (ts == "unknown")
    lo = F.when(unknown, None).when(fs == "none", -LARGEST).when(fs == "unknown", F.when(ts == "none", None).otherwise(F.col("to_v") - F.col("to_p") / 2)).otherwise(lo)
    hi = F.when(unknown, None).when(ts == "none", LARGEST).when(ts == "unknown", F.when(fs == "none", None).otherwise(F.col("from_v") + F.col("from_p") / 2)).otherwise(hi)
    void = ((fs == "unknown") | (ts == "unknown")) & (lo.isNull() | hi.isNull())
    out = df.withColumns({"lo": lo, "hi": hi, "kind": F.when(void, "unknown").otherwise("range"), "__ends": (fs != "none") & (ts != "none")})
    point = F.coalesce(F.col("__ends") & (F.col("lo") >= F.col("hi")), F.lit(False))
    return out.withColumns({"hi": F.when(point, F.col("lo")).otherwise(F.col("hi")), "hi_incl": F.when(F.col("kind") == "range", point)}).drop("__ends")

"""Number tests, percentages and unit conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number text, and the percentage bands.
NUMBER_TEXT = (r"(?iU)^\s*[+-]?(?:(?:\d(?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?(?:e[+-]?\d(?:_?\d)*)?"
               r"|\.\d(?:_?\d)*(?:e[+-]?\d(?:_?\d)*)?|inf(?:inity)?|nan)\s*\z")
GOOD_PCT = 80
FAIR_PCT = 50
POINTS_PER_INCH = 72


def _plain(text: Column) -> Column:
    """Only digits, signs and points: such a text casts exactly as it reads, without a pattern."""
    return (text != "") & (F.translate(text, "0123456789+-.", "") == "")


def is_number(text: Column) -> Column:
    """True for texts that read as a float: digit groups with ``_``, exponents, nan and inf too."""
    return F.coalesce(F.when(_plain(text), text.try_cast("double").isNotNull()).otherwise(text.rlike(NUMBER_TEXT)), F.lit(False))


def to_number(text: Column) -> Column:
    """Value of a number text, NULL for any other text."""
    clean = F.lower(F.replace(F.regexp_replace(text, r"(?U)^\s+|\s+\z", ""), F.lit("_"), F.lit("")))
    other = F.when(text.rlike(NUMBER_TEXT), F.when(clean.rlike(r"^[+-]?nan$"), F.lit(float("nan"))).otherwise(clean.try_cast("double")))
    return F.when(_plain(text), text.try_cast("double")).otherwise(other)


def pct(part: Column, whole: Column) -> Column:
    """Share in percent, 0.0 where the whole is 0."""
    return F.when(whole != 0, part.cast("double") / whole * 100).otherwise(F.lit(0.0))


def pct_band(value: Column) -> Column:
    return F.when(value >= GOOD_PCT, "green").when(value >= FAIR_PCT, "yellow").otherwise("red")


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with ``digits`` places, ties to even."""
    rounded = F.bround(value, digits)
    return F.format_string(f"%.{digits}f", rounded)


def pct_text(value: Column) -> Column:
    return F.concat(fixed(value, 0), F.lit("%"))


def score_text(correct: Column, total: Column) -> Column:
    """``7/8 (88%)``."""
    return F.concat(correct.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("),
                    pct_text(pct(correct, total)), F.lit(")"))


def points_to_pixels(points: Column, dpi: Column | int) -> Column:
    return F.bround(points * dpi / POINTS_PER_INCH, 0).cast("bigint")


def pixels_to_points(pixels: Column, dpi: Column | int) -> Column:
    return pixels * (float(POINTS_PER_INCH) / dpi)

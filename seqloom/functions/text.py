"""Column expressions that read dirty values; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outer blanks: every Unicode white space sign, as text libraries strip them.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def stripped(c: Column | str) -> Column:
    """Without outer blanks; null stays null."""
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def blank_to_null(c: Column | str) -> Column:
    """Without outer blanks, empty becomes null."""
    return F.nullif(stripped(c), F.lit(""))


def category_key(c: Column | str) -> Column:
    """Letter case, outer blanks and the mark between family and detail don't matter."""
    return F.regexp_replace(F.lower(stripped(c)), "[./:-]", ".")


def plain_route(c: Column | str) -> Column:
    """Without outer blanks and without what follows the first ``?`` or ``#``."""
    return stripped(F.substring_index(F.substring_index(stripped(c), "?", 1), "#", 1))


def plain_user(c: Column | str) -> Column:
    """Lower case without outer blanks; empty is none."""
    return F.lower(blank_to_null(c))


def base36(c: Column | str) -> Column:
    """A base-36 number of 1 to 12 letters or digits; anything else, null included, is 0."""
    s = stripped(c)
    return F.coalesce(F.when(s.rlike("^[0-9A-Za-z]{1,12}$"), F.conv(s, 36, 10).cast("bigint")), F.lit(0).cast("bigint"))


def number(c: Column | str) -> Column:
    """A decimal number as DOUBLE, or null; no type suffixes, no NaN or infinity."""
    s = stripped(c)
    return F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"), s.try_cast("double"))


def whole_second(c: Column | str) -> Column:
    """A number of seconds, rounded down, as BIGINT; null where it isn't a number."""
    s = stripped(c)
    plain = r"^[+-]?([0-9]{1,18}\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,2})?$"
    return F.floor(F.when(s.rlike(plain), s.try_cast("decimal(38,12)"))).cast("bigint")

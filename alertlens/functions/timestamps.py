"""Creation-timestamp normalisation.

The branch is chosen from the column's declared type, once, on the driver;
the per-row work is a single built-in expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from alertlens.config import TIMESTAMP_FORMATS
from alertlens.functions.text import strip_ws


# Layouts whose first character is always a digit; when every layout in use is
# one of these, text that does not start with a digit cannot parse.
_DIGIT_LEADING = ("yyyy", "dd/", "dd-", "MM/", "MM-")


def parse_timestamp_text(c: Column, formats: Sequence[str] = TIMESTAMP_FORMATS,
                         fast_iso: bool | None = None) -> Column:
    """Non-strict parse of text: first matching layout wins, junk -> NULL. Text that
    starts with a sign is junk with any list of layouts (``yyyy`` alone would read
    ``-2024-01-02`` as a year before Christ).

    Per-row cost matters here (this runs once per raw alert), so:

    * text already in the canonical ``yyyy-MM-dd[( |T)HH:mm:ss]`` shape (after
      trimming spaces) goes through Spark's native string-to-timestamp cast,
      which gives the same value as the matching layout at a fraction of the
      cost of a pattern formatter;
    * everything else tries the layouts in order (``coalesce`` stops at the
      first match), but only when its first character is a digit - junk
      would otherwise fail every layout, and each failure is an exception
      inside the parser.

    ``fast_iso`` defaults to on for the default layout list, whose first
    layouts are exactly the canonical shapes; pass it explicitly with a custom
    list.
    """
    if fast_iso is None:
        fast_iso = tuple(formats) == TIMESTAMP_FORMATS
    text = c.cast("string")
    s = strip_ws(text)
    attempts = F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)) for fmt in formats])
    first = F.substring(s, 1, 1)
    digits = all(fmt.startswith(_DIGIT_LEADING) for fmt in formats)
    attempts = F.when(first.between("0", "9") if digits else ~first.isin("+", "-"), attempts)
    attempts = attempts.cast("timestamp_ntz")
    if not fast_iso:
        return attempts
    spaced = F.trim(text)
    canonical = (spaced.like("____-__-__") | spaced.like("____-__-__ __:__:__")
                 | spaced.like("____-__-__T__:__:__"))
    return F.coalesce(F.when(canonical, spaced.try_cast("timestamp_ntz")), attempts)


def creation_timestamp(df: DataFrame, column: str = "WW_CREATION_TIMESTAMP",
                       formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    """TIMESTAMP_NTZ expression for ``column`` according to its type.

    DATE -> midnight; TIMESTAMP_NTZ -> unchanged; TIMESTAMP (UTC-adjusted) ->
    wall clock in the session zone (pin the session to UTC); anything else ->
    text, stripped and parsed.
    """
    dtype = df.schema[column].dataType
    c = F.col(column)
    if isinstance(dtype, TimestampNTZType):
        return c
    if isinstance(dtype, (DateType, TimestampType)):
        return c.cast("timestamp_ntz")
    return parse_timestamp_text(c, formats)


def is_typed_time(df: DataFrame, column: str = "WW_CREATION_TIMESTAMP") -> bool:
    """True when the column is a date or timestamp (range predicates push down)."""
    return isinstance(df.schema[column].dataType, (DateType, TimestampType, TimestampNTZType))

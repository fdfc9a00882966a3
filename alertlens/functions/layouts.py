"""Layout election for text timestamps (P3, F3): a column speaks for its rows.

``01/12/2024`` may be 1 December or 12 January; only the rest of the column tells. The first
pass counts for each layout the rows that it parses (one aggregate, a number for each
layout); the second parses with the layouts in the order of their votes, so a row falls back
to the next layout where the elected one doesn't fit it, as in mixed columns. Equal votes
leave the listed order, in which days come before months.

A layout is only tried on text of its length and with its first separator in place: a
failing layout costs an exception a row, and this leaves one or two layouts for each text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlens.config import MONTH_FIRST_FORMATS, TIMESTAMP_FORMATS
from alertlens.functions.text import strip_ws


def fits(text: Column, layout: str) -> Column:
    """Whether stripped text has the layout's length (or its least length, where parts are
    optional or of varying width) and its first separator at the first separator's place."""
    plain = layout.replace("'", "")
    fixed = re.split(r"[\[X]", plain)[0]
    varies = fixed != plain or re.search(r"(?<![A-Za-z])[A-Za-z](?![A-Za-z])", layout.replace("'T'", "")) or "MMM" in plain
    length = F.length(text) >= len(fixed) if varies else F.length(text) == len(fixed)
    first = re.search(r"[^A-Za-z0-9]", fixed)
    if first and re.fullmatch(r"(yyyy|dd|MM|HH)+", fixed[: first.start()]):
        length = length & (F.substring(text, first.start() + 1, 1) == first.group())
    return length & ~F.substring(text, 1, 1).isin("+", "-")


def attempt(text: Column, layout: str) -> Column:
    """TIMESTAMP_NTZ of stripped text in this layout, else NULL."""
    return F.when(fits(text, layout), F.try_to_timestamp(text, F.lit(layout))).cast("timestamp_ntz")


def _canonical(text: Column) -> Column:
    """``yyyy-MM-dd[( |T)HH:mm:ss]`` by Spark's native cast; no layout gives such text another value."""
    shape = text.like("____-__-__") | text.like("____-__-__ __:__:__") | text.like("____-__-__T__:__:__")
    return F.when(shape, text.try_cast("timestamp_ntz"))


def candidates(formats: Sequence[str] = TIMESTAMP_FORMATS) -> tuple[str, ...]:
    """The layouts that stand for election: the listed ones, then their swapped twins."""
    return (*formats, *[f for f in MONTH_FIRST_FORMATS if f not in formats])


def layout_votes(df: DataFrame, column: str = "WW_CREATION_TIMESTAMP",
                 formats: Sequence[str] = TIMESTAMP_FORMATS) -> DataFrame:
    """(position, layout, votes): the rows of the column that each layout parses. Canonical text,
    which is the same in all layouts that take it, doesn't vote."""
    text = strip_ws(F.col(column).cast("string"))
    rows = df.select(text.alias("t")).filter(F.col("t").isNotNull() & _canonical(F.col("t")).isNull())
    layouts = candidates(formats)
    counts = rows.agg(*[F.count(attempt(F.col("t"), f)).alias(f"v{k}") for k, f in enumerate(layouts)])
    each = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(f).alias("layout"), F.col(f"v{k}").alias("votes"))
                     for k, f in enumerate(layouts)])
    return counts.select(F.explode(each).alias("e")).select("e.*")


def elect_layouts(df: DataFrame, column: str = "WW_CREATION_TIMESTAMP",
                  formats: Sequence[str] = TIMESTAMP_FORMATS) -> tuple[str, ...]:
    """The layouts with votes, most votes first; one small job over the column.

    Of the built-in layouts only those with a separator behind two digits can read one text in
    two ways. A column without such text needs no vote and keeps the listed order.
    """
    if set(formats) <= set(TIMESTAMP_FORMATS):
        third = F.substring(strip_ws(F.col(column).cast("string")), 3, 1)
        if df.filter(third.isin("/", "-")).select(F.lit(1)).isEmpty():
            return tuple(formats)
    votes = layout_votes(df, column, formats).collect()  # a row for each layout
    return tuple(r["layout"] for r in sorted(votes, key=lambda r: (-r["votes"], r["position"])) if r["votes"])


def parse_elected(c: Column, elected: Sequence[str]) -> Column:
    """Non-strict parse of text by the elected layouts, in their order; junk -> NULL."""
    text = strip_ws(c.cast("string"))
    return F.coalesce(_canonical(text), *[attempt(text, f) for f in elected])

"""Built-in column expressions used by the operators."""

from alertlens.functions.text import (
    as_clean_string,
    direction_word,
    month_abbr,
    month_full,
    name_text,
    one_decimal,
    period_label,
    period_order,
    round_half_even_int,
    strip_ws,
    thousands,
)
from alertlens.functions.timestamps import creation_timestamp, is_typed_time, parse_timestamp_text

__all__ = [
    "as_clean_string", "creation_timestamp", "direction_word", "is_typed_time", "month_abbr",
    "month_full", "name_text", "one_decimal", "parse_timestamp_text", "period_label",
    "period_order", "round_half_even_int", "strip_ws", "thousands",
]

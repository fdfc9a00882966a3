"""Ranked text insights.

Each insight is a small metric table ``(rank INT, kind STRING, subject STRING,
value BIGINT, text STRING)``. The numbers come from one global aggregation
over already-aggregated series (months, years or statuses); the candidate
rows are built as an array of structs, the ones whose condition fails are
dropped, and ``posexplode`` numbers the survivors. Empty input gives the
single "No ... insight available." row.

Ties the original leaves to an unstable sort are broken deterministically:
earliest period / year, then status name with NULL first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlens.config import (
    CLOSED_PREFIX,
    NONE_TEXT,
    TEXT_AVERAGE,
    TEXT_BACKLOG,
    TEXT_BIGGEST_JUMP,
    TEXT_HIGHEST_YEAR,
    TEXT_LEADER_GAP,
    TEXT_LONG_TERM,
    TEXT_NO_STATUS,
    TEXT_NO_TREND,
    TEXT_NO_YEARLY,
    TEXT_PEAK_PERIOD,
    TEXT_STATIC_TREND_DIRECTION,
    TEXT_THROUGHPUT,
    TEXT_TOP_CONTRIBUTOR,
    TEXT_TOP_STATUS,
    TEXT_TREND_DIRECTION,
)
from alertlens.functions.text import (
    direction_word,
    name_text,
    one_decimal,
    round_half_even_int,
    thousands,
)
from alertlens.operators.metrics import C, N, Y, status_totals, trend_total

INSIGHT_COLUMNS = ("rank", "kind", "subject", "value", "text")


def _item(keep: Column, kind: str, subject: Column | None, value: Column | None,
          text: Column) -> Column:
    none = F.lit(None)
    return F.when(keep, F.struct(
        F.lit(kind).alias("kind"),
        (subject if subject is not None else none).cast("string").alias("subject"),
        (value if value is not None else none).cast("bigint").alias("value"),
        text.cast("string").alias("text"),
    ))


def _emit(one_row: DataFrame, items: list[Column]) -> DataFrame:
    kept = F.filter(F.array(*items), lambda x: x.isNotNull())
    return one_row.select(F.posexplode(kept).alias("_pos", "_it")).select(
        (F.col("_pos") + 1).cast("int").alias("rank"),
        F.col("_it.kind").alias("kind"),
        F.col("_it.subject").alias("subject"),
        F.col("_it.value").alias("value"),
        F.col("_it.text").alias("text"),
    )


def _empty(keep: Column, text: str) -> Column:
    return _item(keep, "empty", None, None, F.lit(text))


# -- I1 ---------------------------------------------------------------------

def trend_total_insights(mart: DataFrame, static_wording: bool = False) -> DataFrame:
    """Peak month; direction and average when more than one month."""
    monthly = trend_total(mart).select("period_label", "period_order", C)
    point = F.struct(F.col("period_label").alias("label"), F.col(C).alias("cnt"))
    s = monthly.agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(point, F.struct(F.col(C), -F.col("period_order"))).alias("peak"),
        F.min_by(point, F.col("period_order")).alias("first"),
        F.max_by(point, F.col("period_order")).alias("last"),
        F.avg(C).alias("avg"),
    )
    n = F.col("n")
    diff = F.col("last.cnt") - F.col("first.cnt")
    avg_value = F.round(F.col("avg"), 0).cast("bigint") if static_wording \
        else round_half_even_int(F.col("avg"))
    template = TEXT_STATIC_TREND_DIRECTION if static_wording else TEXT_TREND_DIRECTION
    return _emit(s, [
        _empty(n == 0, TEXT_NO_TREND),
        _item(n >= 1, "peak_period", F.col("peak.label"), F.col("peak.cnt"),
              F.format_string(TEXT_PEAK_PERIOD, F.col("peak.label"), thousands(F.col("peak.cnt")))),
        _item(n > 1, "direction", F.concat_ws(" to ", "first.label", "last.label"), diff,
              F.format_string(template, direction_word(diff), thousands(F.abs(diff)),
                              F.col("first.label"), F.col("last.label"))),
        _item(n > 1, "average", None, avg_value,
              F.format_string(TEXT_AVERAGE, thousands(avg_value))),
    ])


# -- I2 ---------------------------------------------------------------------

def trend_compare_insights(mart: DataFrame, null_name_label: str | None = None) -> DataFrame:
    """Top three contributing statuses and the leader's gap.

    NULL names are left out of the ranking (they still make the input
    non-empty); with ``null_name_label`` they rank under that text, as on the
    static page.
    """
    if null_name_label is not None:
        mart = mart.withColumn(N, F.coalesce(F.col(N), F.lit(null_name_label)))
    summary = status_totals(mart)
    top = summary.orderBy(F.col(N).isNull(), F.desc(C), F.asc(N)).limit(3)
    s = top.agg(F.sort_array(F.collect_list(F.struct(
        F.col(N).isNull().alias("_null"), (-F.col(C)).alias("_neg"),
        F.col(N).alias("name"), F.col(C).alias("cnt"),
    ))).alias("arr")).select(
        F.size("arr").alias("n_all"),
        F.filter("arr", lambda x: ~x["_null"]).alias("named"),
    )
    named = F.col("named")
    items = [_empty(F.col("n_all") == 0, TEXT_NO_TREND)]
    for i in range(3):
        e = named[i]
        items.append(_item(F.size(named) > i, "top_contributor", e["name"], e["cnt"],
                           F.format_string(TEXT_TOP_CONTRIBUTOR, F.lit(i + 1), e["name"],
                                           thousands(e["cnt"]))))
    gap = named[0]["cnt"] - named[1]["cnt"]
    items.append(_item(F.size(named) > 1, "leader_gap", named[0]["name"], gap,
                       F.format_string(TEXT_LEADER_GAP, named[0]["name"], thousands(gap))))
    return _emit(s, items)


def trend_insights(mart: DataFrame, mode: str = "total", static_wording: bool = False,
                   null_name_label: str | None = None) -> DataFrame:
    if mode == "compare":
        return trend_compare_insights(mart, null_name_label)
    return trend_total_insights(mart, static_wording=static_wording)


# -- I3 ---------------------------------------------------------------------

def status_insights(mart: DataFrame, closed_prefix: str = CLOSED_PREFIX) -> DataFrame:
    """Top three statuses with their share, then the open/closed signal.

    Here a NULL name counts as open (it prints as 'None', which does not
    start with the closed prefix).
    """
    totals = status_totals(mart)
    closed = F.coalesce(F.col(N), F.lit(NONE_TEXT)).startswith(closed_prefix)
    stats = totals.agg(F.struct(
        F.sum(C).alias("total"),
        F.coalesce(F.sum(F.when(closed, F.col(C))), F.lit(0)).alias("closed"),
        F.coalesce(F.sum(F.when(~closed, F.col(C))), F.lit(0)).alias("open"),
    )).scalar()
    top = totals.orderBy(F.desc(C), F.asc_nulls_first(N)).limit(3)
    s = top.agg(F.sort_array(F.collect_list(F.struct(
        (-F.col(C)).alias("_neg"), F.col(N).alias("name"), F.col(C).alias("cnt"),
    ))).alias("arr")).select("arr", stats.alias("st"))
    arr = F.col("arr")
    total = F.col("st.total")
    items = [_empty(total.isNull(), TEXT_NO_STATUS)]
    for i in range(3):
        e = arr[i]
        pct = e["cnt"].cast("double") / total.cast("double") * F.lit(100.0)
        items.append(_item(F.size(arr) > i, "top_status", e["name"], e["cnt"],
                           F.format_string(TEXT_TOP_STATUS, F.lit(i + 1), name_text(e["name"]),
                                           thousands(e["cnt"]), one_decimal(pct))))
    backlog = F.col("st.open") > F.col("st.closed")
    items.append(_item(total.isNotNull(), "signal",
                       F.when(backlog, F.lit("backlog")).otherwise(F.lit("throughput")),
                       F.col("st.open") - F.col("st.closed"),
                       F.when(backlog, F.lit(TEXT_BACKLOG)).otherwise(F.lit(TEXT_THROUGHPUT))))
    return _emit(s, items)


# -- I4 ---------------------------------------------------------------------

def yearly_insights(mart: DataFrame, positive_only: bool = False) -> DataFrame:
    """Peak year; long-term direction and biggest year-on-year jump (I4).

    The window runs over per-year totals only. ``positive_only`` drops the
    jump row when no year grew (the static page's rule).
    """
    totals = mart.groupBy(Y).agg(F.sum(C).cast("bigint").alias(C))
    change = F.col(C) - F.lag(C).over(Window.orderBy(Y))
    totals = totals.withColumn("change", change)
    point = F.struct(F.col(Y).alias("year"), F.col(C).alias("cnt"))
    s = totals.agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(point, F.struct(F.col(C), -F.col(Y))).alias("top"),
        F.min_by(point, F.col(Y)).alias("first"),
        F.max_by(point, F.col(Y)).alias("last"),
        F.max_by(F.struct(F.col(Y).alias("year"), F.col("change").alias("change")),
                 F.when(F.col("change").isNotNull(),
                        F.struct(F.col("change"), -F.col(Y)))).alias("jump"),
    )
    n = F.col("n")
    diff = F.col("last.cnt") - F.col("first.cnt")
    jump_ok = (n > 1) & F.col("jump").isNotNull()
    if positive_only:
        jump_ok = jump_ok & (F.col("jump.change") > 0)
    return _emit(s, [
        _empty(n == 0, TEXT_NO_YEARLY),
        _item(n >= 1, "highest_year", F.col("top.year"), F.col("top.cnt"),
              F.format_string(TEXT_HIGHEST_YEAR, F.col("top.year"), thousands(F.col("top.cnt")))),
        _item(n > 1, "long_term",
              F.concat_ws(" to ", F.col("first.year").cast("string"),
                          F.col("last.year").cast("string")), diff,
              F.format_string(TEXT_LONG_TERM, direction_word(diff), thousands(F.abs(diff)),
                              F.col("first.year"), F.col("last.year"))),
        _item(jump_ok, "biggest_jump", F.col("jump.year"), F.col("jump.change"),
              F.format_string(TEXT_BIGGEST_JUMP, F.col("jump.year"),
                              thousands(F.col("jump.change")))),
    ])

"""Windows, explorer levels, drill-down and text insights."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from alertlens.operators import explorer, insights, windows
from alertlens.operators.filters import apply_filters
from tests.conftest import mart_frame

# -- windows -----------------------------------------------------------------------


def test_yoy_golden(clean_mart_01, dirty_mart_01):
    assert [r.change for r in windows.yoy_change(clean_mart_01).collect()] == [-48, 61, -92, 92, 76, -862]
    assert [r.change for r in windows.yoy_change(dirty_mart_01).collect()] == [-78, 79, -73, 33, 93, -655]


def test_yoy_uses_previous_present_year(spark):
    m = mart_frame(spark, [(2019, 1, 1, "a", 5), (2021, 3, 1, "a", 8)])
    rows = windows.yoy_change(m).collect()
    assert [(r.year_creation, r.prev, r.change) for r in rows] == [(2021, 5, 3)]


def test_top3_tie_broken_by_name(dirty_mart_01):
    rows = windows.top_statuses(dirty_mart_01).collect()
    assert [(r.rank, r.NAME, r.Count) for r in rows] == [
        (1, "Under Review", 1143), (2, "Closed - Rejected", 1136), (3, "Closed - Accepted", 1127)]


def test_share_includes_null_names_in_denominator(dirty_mart_01):
    rows = windows.status_share(dirty_mart_01).collect()
    assert abs(sum(r.share_pct for r in rows) - 100.0) < 1e-9
    top = rows[0]
    assert abs(top.share_pct - 1143 / 8890 * 100) < 1e-12


def test_peaks(clean_mart_01, dirty_mart_01, clean_mart_001, dirty_mart_001):
    for mart, expected in ((clean_mart_01, (199507, 186)), (dirty_mart_01, (200107, 140)),
                           (clean_mart_001, (199603, 26)), (dirty_mart_001, (199506, 22))):
        p = windows.peak_period(mart).first()
        assert (p.period_order, p.Count) == expected
    assert tuple(windows.peak_year(clean_mart_01).first()) == (2000, 1916)


# -- explorer ----------------------------------------------------------------------

@pytest.mark.parametrize("fixture,levels", [
    ("clean_mart_001", [5, 35, 375, 1140]), ("clean_mart_01", [5, 35, 397, 7570]),
    ("dirty_mart_001", [8, 56, 483, 883]), ("dirty_mart_01", [8, 56, 633, 7086]),
])
def test_drilldown_levels(request, fixture, levels):
    mart = request.getfixturevalue(fixture)
    d = explorer.drilldown(mart)
    got = [r[1] for r in d.groupBy("level").count().orderBy("level").collect()]
    assert got == levels


def test_drilldown_children_add_up(dirty_mart_001):
    d = explorer.drilldown(dirty_mart_001).cache()
    keys = {1: ["NAME"], 2: ["NAME", "year_creation"], 3: ["NAME", "year_creation", "mth_creation"]}
    for parent, cols in keys.items():
        child = d.filter(F.col("level") == parent + 1).groupBy(*cols).agg(F.sum("total_count").alias("s"))
        par = d.filter(F.col("level") == parent).select(*cols, "total_count")
        joined = par.join(child, [par[c].eqNullSafe(child[c]) for c in cols])
        assert joined.filter(F.col("s") != F.col("total_count")).count() == 0
        assert joined.count() == par.count()


def test_drilldown_tree_order(dirty_mart_001):
    rows = explorer.drilldown(dirty_mart_001, ["New"]).collect()
    assert rows[0].level == 1 and rows[1].level == 2
    years = [r.year_creation for r in rows if r.level == 2]
    assert years == sorted(years, reverse=True)


def test_drilldown_abbr_labels(dirty_mart_001):
    labels = {r.month_label for r in explorer.drilldown(dirty_mart_001, "New", "abbr").collect()
              if r.level == 3}
    assert "Jan" in labels and "January" not in labels


def test_explorer_levels(dirty_mart_01):
    years = explorer.explorer_years(dirty_mart_01, "Escalated").collect()
    assert [r.year for r in years] == list(range(2001, 1994, -1))
    months = explorer.explorer_months(dirty_mart_01, "Escalated", "1996").collect()
    assert months[0].month == "January" and len(months) == 12
    total = sum(r.total_count for r in months)
    assert total == [r.total_count for r in years if r.year == 1996][0]
    dates = explorer.explorer_dates(dirty_mart_01, "Escalated", 1996, 3).collect()
    assert sum(r.total_count for r in dates) == months[2].total_count
    assert dates[0].date.startswith("1996-03-")


def test_explorer_missing_arguments_are_empty(dirty_mart_001):
    assert explorer.explorer_years(dirty_mart_001, "").count() == 0
    assert explorer.explorer_months(dirty_mart_001, "New", None).count() == 0
    assert explorer.explorer_dates(dirty_mart_001, "New", 1997, "").count() == 0


# -- insights ------------------------------------------------------------------------

def _texts(df):
    return [r.text for r in df.orderBy("rank").collect()]


def test_trend_insights_golden(clean_mart_01):
    assert _texts(insights.trend_total_insights(clean_mart_01)) == [
        "Peak workload period: Jul 1995 recorded the highest total with 186 alerts.",
        "Trend direction: selected alert volume decreased by 143 from Jan 1995 to Aug 2001.",
        "Average monthly workload across the selected period is 150 alerts.",
    ]


def test_compare_insights_golden(dirty_mart_01):
    assert _texts(insights.trend_compare_insights(dirty_mart_01)) == [
        "Top 1 trend contributor: Under Review accounts for 1,143 alerts in the selected period.",
        "Top 2 trend contributor: Closed - Rejected accounts for 1,136 alerts in the selected period.",
        "Top 3 trend contributor: Closed - Accepted accounts for 1,127 alerts in the selected period.",
        "Comparison signal: Under Review leads the next selected status by 7 alerts.",
    ]


def test_status_insights_golden(dirty_mart_01):
    texts = _texts(insights.status_insights(dirty_mart_01))
    assert texts[0] == ("Top 1 status: Under Review contributes 1,143 alerts "
                        "(12.9% of selected workload).")
    assert texts[-1].startswith("Operational signal: open-stage alerts exceed")


def test_yearly_insights_golden(clean_mart_01):
    assert _texts(insights.yearly_insights(clean_mart_01)) == [
        "Highest year: 2000 recorded the largest total with 1,916 alerts.",
        "Long-term direction: yearly workload decreased by 773 from 1995 to 2001.",
        "Biggest year-on-year jump: 1999 rose by 92 versus the previous year.",
    ]


def test_empty_inputs_give_one_row(spark):
    empty = mart_frame(spark, [])
    assert _texts(insights.trend_total_insights(empty)) == ["No trend insight available."]
    assert _texts(insights.trend_compare_insights(empty)) == ["No trend insight available."]
    assert _texts(insights.status_insights(empty)) == ["No status insight available."]
    assert _texts(insights.yearly_insights(empty)) == ["No yearly insight available."]


def test_single_period_has_no_direction(spark):
    m = mart_frame(spark, [(2024, 5, 1, "a", 1200), (2024, 5, 2, "b", 3)])
    assert [r.kind for r in insights.trend_total_insights(m).collect()] == ["peak_period"]
    assert [r.kind for r in insights.yearly_insights(m).collect()] == ["highest_year"]
    kinds = [r.kind for r in insights.trend_compare_insights(m).collect()]
    assert kinds == ["top_contributor", "top_contributor", "leader_gap"]


def test_only_null_names_in_compare_gives_nothing(spark):
    m = mart_frame(spark, [(2024, 5, 1, None, 4)])
    assert insights.trend_compare_insights(m).count() == 0


def test_open_equals_closed_is_throughput(spark):
    m = mart_frame(spark, [(2024, 1, 1, "Closed", 5), (2024, 1, 1, "New", 5)])
    assert _texts(insights.status_insights(m))[-1].startswith("Operational signal: closed-stage")


def test_null_name_counts_as_open_in_status_insight(spark):
    m = mart_frame(spark, [(2024, 1, 1, "Closed", 5), (2024, 1, 1, None, 6)])
    texts = _texts(insights.status_insights(m))
    assert texts[0].startswith("Top 1 status: None contributes 6 alerts (54.5%")
    assert texts[-1].startswith("Operational signal: open-stage")


def test_all_years_falling(spark):
    m = mart_frame(spark, [(2019, 1, 1, "a", 9), (2020, 1, 1, "a", 5), (2021, 1, 1, "a", 2)])
    texts = _texts(insights.yearly_insights(m))
    assert texts[-1] == "Biggest year-on-year jump: 2021 rose by -3 versus the previous year."
    static = _texts(insights.yearly_insights(m, positive_only=True))
    assert not any(t.startswith("Biggest") for t in static)


def test_average_rounds_half_to_even(spark):
    m = mart_frame(spark, [(2024, 1, 1, "a", 2), (2024, 2, 1, "a", 3)])
    avg = [r for r in insights.trend_total_insights(m).collect() if r.kind == "average"][0]
    assert avg.value == 2 and avg.text.endswith("is 2 alerts.")


def test_static_wording_and_rounding(spark):
    m = mart_frame(spark, [(2024, 1, 1, "a", 2), (2024, 2, 1, "a", 3)])
    texts = _texts(insights.trend_total_insights(m, static_wording=True))
    assert texts[1] == "Trend direction: alert volume increased by 1 from Jan 2024 to Feb 2024."
    assert texts[2] == "Average monthly workload across the selected period is 3 alerts."


def test_explorer_month_abbreviations(dirty_mart_001):
    rows = explorer.explorer_months(dirty_mart_001, "New", 1997, month_labels="abbr").collect()
    assert rows and all(len(r.month) == 3 for r in rows)


def test_thousands_separator(spark):
    m = mart_frame(spark, [(2024, 1, 1, "a", 1234567)])
    assert "1,234,567" in _texts(insights.trend_total_insights(m))[0]


def test_insights_respect_filters(dirty_mart_01):
    mart = apply_filters(dirty_mart_01, names="Closed", years=[1999, 2000])
    kinds = [r.kind for r in insights.trend_total_insights(mart).collect()]
    assert kinds == ["peak_period", "direction", "average"]

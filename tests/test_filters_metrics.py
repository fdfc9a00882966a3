"""Selections, KPIs, distributions, trends, yearly breakdowns, options."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from alertlens.operators import metrics
from alertlens.operators.filters import apply_filters, lookup, normalize_selection
from tests.conftest import mart_frame

# -- selections --------------------------------------------------------------------


@pytest.mark.parametrize("value,expected", [
    (None, []), ("", []), ("ALL", []), ([], []), (["ALL"], []), (("", None), []),
    (["ALL", "New"], ["New"]), ("New", ["New"]), (2024, [2024]), ({"a"}, ["a"]),
])
def test_normalize_selection(value, expected):
    assert normalize_selection(value) == expected


def test_no_filter_values_keep_everything(dirty_mart_001):
    n = dirty_mart_001.count()
    for sel in (None, "", "ALL", [], ["ALL"]):
        assert apply_filters(dirty_mart_001, sel, sel, sel).count() == n


def test_name_selection_strips_and_drops_nulls(dirty_mart_001):
    a = apply_filters(dirty_mart_001, names=" New ")
    b = apply_filters(dirty_mart_001, names=["New"])
    assert a.count() == b.count() > 0
    assert a.filter(F.col("NAME").isNull()).count() == 0


def test_all_plus_name_is_only_that_name(dirty_mart_001):
    names = {r.NAME for r in apply_filters(dirty_mart_001, names=["ALL", "New"]).collect()}
    assert names == {"New"}


def test_invalid_year_or_month_is_empty_with_schema(dirty_mart_001):
    for kwargs in ({"years": ["abc"]}, {"months": ["x"]}, {"years": [None, "1.5"]}):
        out = apply_filters(dirty_mart_001, **kwargs)
        assert out.count() == 0 and out.columns == dirty_mart_001.columns


def test_year_as_text_equals_year_as_int(dirty_mart_001):
    a = apply_filters(dirty_mart_001, years=["1997"]).collect()
    b = apply_filters(dirty_mart_001, years=1997).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and a


def test_lookup_missing_argument_is_empty(dirty_mart_001):
    assert lookup(dirty_mart_001, None).count() == 0
    assert lookup(dirty_mart_001, "", None).count() == 0
    assert lookup(dirty_mart_001, "New", None, need_year=True).count() == 0
    assert lookup(dirty_mart_001, "New", 1997, "", need_year=True, need_month=True).count() == 0


def test_lookup_all_means_every_value_of_that_level(dirty_mart_001):
    assert lookup(dirty_mart_001, "ALL").count() == dirty_mart_001.count()
    only_new = apply_filters(dirty_mart_001, "New").count()
    assert lookup(dirty_mart_001, "New", "ALL", need_year=True).count() == only_new


@pytest.mark.parametrize("fixture,expected", [
    ("clean_mart_001", (11, 11)), ("clean_mart_01", (69, 105)),
    ("dirty_mart_001", (3, 3)), ("dirty_mart_01", (52, 61)),
])
def test_combined_filter_golden(request, fixture, expected):
    mart = request.getfixturevalue(fixture)
    out = apply_filters(mart, ["Escalated", "BUILDING"], [1996, 1997], [1, 2])
    r = out.agg(F.count(F.lit(1)), F.sum("Count")).first()
    assert (r[0], r[1]) == expected


def test_filtered_total_not_above_total(dirty_mart_01):
    total = dirty_mart_01.agg(F.sum("Count")).first()[0]
    part = apply_filters(dirty_mart_01, years=[1999]).agg(F.sum("Count")).first()[0]
    assert 0 < part <= total


# -- KPIs ---------------------------------------------------------------------------

def test_kpis_golden(dirty_mart_01, clean_mart_01, dirty_mart_001):
    b = metrics.kpis(dirty_mart_01).first().asDict()
    assert b == {"total_alerts": 8890, "open_alerts": 4392, "closed_alerts": 3375,
                 "escalated_alerts": 1127, "closure_rate": 38.0, "escalation_rate": 12.7}
    a = metrics.kpis(clean_mart_01).first()
    assert (a.total_alerts, a.open_alerts, a.closure_rate, a.escalation_rate) == (12004, 12004, 0.0, 0.0)
    s = metrics.kpis(dirty_mart_001).first()
    assert (s.total_alerts, s.open_alerts, s.closure_rate, s.escalation_rate) == (904, 448, 39.5, 12.1)


def test_open_closed_null_add_up(dirty_mart_01):
    k = metrics.kpis(dirty_mart_01).first()
    nulls = dirty_mart_01.filter(F.col("NAME").isNull()).agg(F.sum("Count")).first()[0]
    assert k.open_alerts + k.closed_alerts + nulls == k.total_alerts


def test_kpis_on_empty_mart(spark):
    empty = mart_frame(spark, [])
    r = metrics.kpis(empty).collect()
    assert len(r) == 1
    assert r[0].asDict() == {"total_alerts": 0, "open_alerts": 0, "closed_alerts": 0,
                             "escalated_alerts": 0, "closure_rate": 0.0, "escalation_rate": 0.0}


def test_legacy_lowercase_closed_is_open(spark):
    m = mart_frame(spark, [(2024, 1, 1, "closed (legacy)", 3), (2024, 1, 1, "Closed", 1)])
    k = metrics.kpis(m).first()
    assert (k.open_alerts, k.closed_alerts) == (3, 1)


# -- distribution, trends, yearly ------------------------------------------------------

def test_status_distribution_golden_with_tie(dirty_mart_01):
    rows = [(r.NAME, r.Count) for r in metrics.status_distribution(dirty_mart_01).collect()]
    assert rows == [("Under Review", 1143), ("Closed - Rejected", 1136),
                    ("Closed - Accepted", 1127), ("Escalated", 1127), (None, 1123),
                    ("Closed", 1112), ("New", 1079), ("closed (legacy)", 1043)]


def test_clean_distribution_golden(clean_mart_01):
    rows = [(r.NAME, r.Count) for r in metrics.status_distribution(clean_mart_01).collect()]
    assert rows == [("MACHINERY", 2499), ("HOUSEHOLD", 2409), ("FURNITURE", 2379),
                    ("AUTOMOBILE", 2363), ("BUILDING", 2354)]


def test_trend_total_golden(clean_mart_01, dirty_mart_001):
    rows = metrics.trend_total(clean_mart_01).collect()
    assert len(rows) == 80
    assert (rows[0].period_order, rows[0].Count) == (199501, 145)
    assert (rows[-1].period_order, rows[-1].Count) == (200108, 2)
    assert rows[0].period_label == "Jan 1995"
    peak = max(rows, key=lambda r: (r.Count, -r.period_order))
    assert (peak.period_order, peak.Count) == (199507, 186)
    b = metrics.trend_total(dirty_mart_001).collect()
    assert (b[0].period_order, b[0].Count, b[-1].period_order, b[-1].Count) == (199501, 7, 200107, 21)


@pytest.mark.parametrize("fixture,sparse,dense", [
    ("clean_mart_001", 375, 395), ("clean_mart_01", 397, 400),
    ("dirty_mart_001", 483, 632), ("dirty_mart_01", 633, 640),
])
def test_compare_trend_sparse_and_dense(request, fixture, sparse, dense):
    mart = request.getfixturevalue(fixture)
    s = metrics.trend_compare(mart)
    d = metrics.trend_compare_dense(mart)
    assert s.count() == sparse and d.count() == dense
    assert s.agg(F.sum("Count")).first()[0] == d.agg(F.sum("Count")).first()[0]
    assert d.filter(F.col("Count") == 0).count() == dense - sparse


def test_yearly_golden(clean_mart_01, dirty_mart_01, clean_mart_001, dirty_mart_001):
    def totals(m):
        return [r.YearTotal for r in metrics.year_totals(m).collect()]

    assert totals(clean_mart_01) == [1827, 1779, 1840, 1748, 1840, 1916, 1054]
    assert totals(dirty_mart_01) == [1375, 1297, 1376, 1303, 1336, 1429, 774]
    assert totals(clean_mart_001) == [186, 193, 170, 195, 198, 168, 96]
    assert totals(dirty_mart_001) == [149, 145, 124, 143, 150, 121, 72]
    assert metrics.yearly_breakdown(dirty_mart_01).count() == 56
    assert metrics.yearly_dense(dirty_mart_001).count() == 56
    assert metrics.year_total_max(clean_mart_01).first()[0] == 1916


def test_year_total_max_empty(spark):
    assert metrics.year_total_max(mart_frame(spark, [])).first()[0] == 0


def test_names_and_options(dirty_mart_01):
    names = metrics.names_totals(dirty_mart_01).collect()
    assert names[0].NAME is None and len(names) == 8
    years = [r[0] for r in metrics.available_years(apply_filters(dirty_mart_01, "New")).collect()]
    assert years == list(range(1995, 2002))
    months = metrics.available_months(apply_filters(dirty_mart_01, "New", 2001)).collect()
    assert [(r.label, r.value) for r in months][:2] == [("January", 1), ("February", 2)]
    present = {r.mth_creation for r in apply_filters(dirty_mart_01, "New", 2001).collect()}
    assert [r.value for r in months] == sorted(present)


def test_trend_mode_switch(dirty_mart_001):
    assert "NAME" not in metrics.monthly_trend(dirty_mart_001, "total").columns
    assert "NAME" in metrics.monthly_trend(dirty_mart_001, "compare").columns
    assert metrics.monthly_trend(dirty_mart_001, "compare", dense=True).count() == 632

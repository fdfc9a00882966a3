"""Random small marts: Spark operators against a brute-force Python model.

The model below restates the dashboard rules directly on Python lists (the
same rules the SURVEY cites); Hypothesis draws marts with NULL names, closed
and escalated names, gaps in years and months, and counts above 1,000 so the
thousands separator is exercised.
"""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from alertlens.operators import insights, metrics, windows
from alertlens.operators.filters import apply_filters
from alertlens.operators.mart import MART_SCHEMA

NAMES = [None, "New", "Escalated", "Closed", "Closed - Accepted", "closed (legacy)", "Under Review"]
MONTHS = ["", "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

key = st.tuples(st.integers(2019, 2023), st.integers(1, 12), st.integers(1, 28),
                st.sampled_from(NAMES))
marts = st.dictionaries(key, st.integers(1, 2500), max_size=40)
selections = st.fixed_dictionaries({
    "names": st.one_of(st.none(), st.lists(st.sampled_from(NAMES[1:] + ["ALL"]), max_size=3)),
    "years": st.one_of(st.none(), st.lists(st.integers(2019, 2023), max_size=2)),
    "months": st.one_of(st.none(), st.lists(st.integers(1, 12), max_size=3)),
})


def model_filter(rows, names, years, months):
    """Set algebra over the drawn rows: the rows of every selected item united, the
    dimensions intersected."""
    chosen = set(rows)
    for place, items in ((3, names), (0, years), (1, months)):
        given = set(items or ()) - {"ALL", "", None}
        if given:
            chosen &= {r for r in rows for item in given if r[place] == item}
    return [r for r in rows if r in chosen]


def sums(rows, keyf):
    acc = defaultdict(int)
    for r in rows:
        acc[keyf(r)] += r[4]
    return acc


def ranked(acc):
    """(name, count) by count desc, then name asc with None first."""
    return sorted(acc.items(), key=lambda kv: (-kv[1], kv[0] is not None, kv[0] or ""))


def model_kpis(rows):
    total = sum(r[4] for r in rows)
    closed = sum(r[4] for r in rows if r[3] is not None and r[3].startswith("Closed"))
    opened = sum(r[4] for r in rows if r[3] is not None and not r[3].startswith("Closed"))
    esc = sum(r[4] for r in rows if r[3] == "Escalated")

    def rate(x):
        if not total:
            return 0.0
        return float(Decimal(repr(x / total * 100)).quantize(Decimal("0.1"), ROUND_HALF_UP))

    return (total, opened, closed, esc, rate(closed), rate(esc))


def model_trend_texts(rows):
    if not rows:
        return ["No trend insight available."]
    acc = sums(rows, lambda r: r[0] * 100 + r[1])
    periods = sorted(acc)
    label = lambda p: f"{MONTHS[p % 100]} {p // 100}"
    peak = min(periods, key=lambda p: (-acc[p], p))
    out = [f"Peak workload period: {label(peak)} recorded the highest total with {acc[peak]:,} alerts."]
    if len(periods) > 1:
        diff = acc[periods[-1]] - acc[periods[0]]
        word = "increased" if diff >= 0 else "decreased"
        out.append(f"Trend direction: selected alert volume {word} by {abs(diff):,} "
                   f"from {label(periods[0])} to {label(periods[-1])}.")
        avg = sum(acc.values()) / len(acc)
        out.append(f"Average monthly workload across the selected period is {avg:,.0f} alerts.")
    return out


def model_compare_texts(rows):
    if not rows:
        return ["No trend insight available."]
    acc = {k: v for k, v in sums(rows, lambda r: r[3]).items() if k is not None}
    top = ranked(acc)
    out = [f"Top {i} trend contributor: {n} accounts for {c:,} alerts in the selected period."
           for i, (n, c) in enumerate(top[:3], start=1)]
    if len(top) > 1:
        out.append(f"Comparison signal: {top[0][0]} leads the next selected status by "
                   f"{top[0][1] - top[1][1]:,} alerts.")
    return out


def model_status_texts(rows):
    if not rows:
        return ["No status insight available."]
    acc = sums(rows, lambda r: r[3])
    total = sum(acc.values())
    out = []
    for i, (n, c) in enumerate(ranked(acc)[:3], start=1):
        pct = Decimal(repr(c / total * 100)).quantize(Decimal("0.1"), ROUND_HALF_UP)
        out.append(f"Top {i} status: {n} contributes {c:,} alerts ({pct}% of selected workload).")
    closed = sum(c for n, c in acc.items() if str(n).startswith("Closed"))
    opened = total - closed
    out.append("Operational signal: open-stage alerts exceed closed-stage alerts, which may indicate backlog pressure."
               if opened > closed else
               "Operational signal: closed-stage alerts remain higher than open-stage alerts, suggesting stronger completion throughput.")
    return out


def model_yearly_texts(rows):
    if not rows:
        return ["No yearly insight available."]
    acc = sums(rows, lambda r: r[0])
    years = sorted(acc)
    top = min(years, key=lambda y: (-acc[y], y))
    out = [f"Highest year: {top} recorded the largest total with {acc[top]:,} alerts."]
    if len(years) > 1:
        diff = acc[years[-1]] - acc[years[0]]
        word = "increased" if diff >= 0 else "decreased"
        out.append(f"Long-term direction: yearly workload {word} by {abs(diff):,} "
                   f"from {years[0]} to {years[-1]}.")
        changes = [(acc[b] - acc[a], b) for a, b in zip(years, years[1:])]
        best = min(changes, key=lambda cb: (-cb[0], cb[1]))
        out.append(f"Biggest year-on-year jump: {best[1]} rose by {best[0]:,} versus the previous year.")
    return out


def _texts(df):
    return [r.text for r in df.orderBy("rank").collect()]


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(data=marts, sel=selections)
def test_operators_match_model(spark, data, sel):
    rows = [(y, m, d, n, c) for (y, m, d, n), c in data.items()]
    df = spark.createDataFrame([(y, m, dt.date(y, m, d), n, c) for (y, m, d, n, c) in rows],
                               MART_SCHEMA)
    filtered = apply_filters(df, **sel)
    expect = model_filter(rows, **sel)

    got_rows = sorted((r.year_creation, r.mth_creation, r.dt_creation.day, r.NAME or "", r.Count)
                      for r in filtered.collect())
    assert got_rows == sorted((y, m, d, n or "", c) for (y, m, d, n, c) in expect)

    k = metrics.kpis(filtered).first()
    assert (k.total_alerts, k.open_alerts, k.closed_alerts, k.escalated_alerts,
            k.closure_rate, k.escalation_rate) == model_kpis(expect)

    dist = [(r.NAME, r.Count) for r in metrics.status_distribution(filtered).collect()]
    assert dist == ranked(sums(expect, lambda r: r[3]))

    yoy = [(r.year_creation, r.change) for r in windows.yoy_change(filtered).collect()]
    yacc = sums(expect, lambda r: r[0])
    ys = sorted(yacc)
    assert yoy == [(b, yacc[b] - yacc[a]) for a, b in zip(ys, ys[1:])]

    dense = metrics.trend_compare_dense(filtered)
    n_names = len({r[3] for r in expect})
    n_periods = len({(r[0], r[1]) for r in expect})
    assert dense.count() == n_names * n_periods

    assert _texts(insights.trend_total_insights(filtered)) == model_trend_texts(expect)
    assert _texts(insights.trend_compare_insights(filtered)) == model_compare_texts(expect)
    assert _texts(insights.status_insights(filtered)) == model_status_texts(expect)
    assert _texts(insights.yearly_insights(filtered)) == model_yearly_texts(expect)


# -- the mart itself: raw alerts + statuses against a Python model -------------------

DOMAINS = [None, "OTHER", " SUSPICIOUS ACTIVITY ", "\tSUSPICIOUS ACTIVITY\n",
           "suspicious activity", "SUSPICIOUS ACTIVITY", " SUSPICIOUS ACTIVITY", "X SUSPICIOUS ACTIVITY"]
TS_FORMS = ["{y:04d}-{m:02d}-{d:02d} {h:02d}:30:00", " {y:04d}-{m:02d}-{d:02d}T{h:02d}:30:00 ",
            "{y:04d}-{m:02d}-{d:02d}", "{y:04d}/{m:02d}/{d:02d}", "{d:02d}/{m:02d}/{y:04d}",
            "\t{y:04d}-{m:02d}-{d:02d} {h:02d}:30:00.25\n"]
JUNK = [None, "not a date", "", "2021-02-30", "31/31/2021"]
PAD_NAMES = ["New", " New ", "\tClosed\n", "Escalated", "Under Review ", "　Closed - Accepted"]

raw_alert = st.tuples(
    st.one_of(st.none(), st.integers(0, 6)),
    st.one_of(
        st.tuples(st.integers(2020, 2022), st.integers(1, 12), st.integers(1, 28),
                  st.integers(0, 23), st.integers(0, len(TS_FORMS) - 1)),
        st.sampled_from(JUNK)),
    st.sampled_from(DOMAINS),
)
dimension = st.lists(st.tuples(st.integers(0, 5), st.sampled_from(PAD_NAMES)), max_size=8)


def _ts_text(spec):
    if spec is None or isinstance(spec, str):
        return spec
    y, m, d, h, form = spec
    return TS_FORMS[form].format(y=y, m=m, d=d, h=h)


def _ts_date(spec):
    if spec is None or isinstance(spec, str):
        return None  # junk never parses
    y, m, d, _h, _form = spec
    return dt.date(y, m, d)


def _strip(s):
    return None if s is None else s.strip(" \t\n\r\x0b\x0c 　\u0085")


def model_mart(alerts, dim, excluded="SUSPICIOUS ACTIVITY"):
    counts = defaultdict(int)
    for sid, spec, dom in alerts:
        if dom is None or _strip(dom) == excluded:
            continue
        day = _ts_date(spec)
        if day is None:
            continue
        names = [_strip(n) for i, n in dim if sid is not None and i == sid] or [None]
        for n in names:
            counts[(day, n)] += 1
    return sorted((d.year, d.month, d, n or "", c) for (d, n), c in counts.items())


@settings(max_examples=10, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(alerts=st.lists(raw_alert, max_size=40), dim=dimension)
def test_build_mart_matches_model(spark, alerts, dim):
    from alertlens.operators.mart import build_mart

    fact = spark.createDataFrame(
        [(sid, _ts_text(spec), dom) for sid, spec, dom in alerts],
        "WW_STATUS_ID int, WW_CREATION_TIMESTAMP string, WW_DOMAIN_CODE string")
    statuses = spark.createDataFrame(dim, "ID int, NAME string")
    expect = model_mart(alerts, dim)
    for bound in (1000, 0):
        got = sorted((r.year_creation, r.mth_creation, r.dt_creation, r.NAME or "", r.Count)
                     for r in build_mart(fact, statuses, broadcast_max_rows=bound).collect())
        assert got == expect, bound

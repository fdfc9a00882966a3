"""DuckDB SQL equivalents of the catalog queries (the correctness oracle).

Written from the base tables with DuckDB's own functions - its own adapter
CTEs, its own timestamp parsing, its own joins - so it checks the Spark
plans rather than restating them. DuckDB returns BIGINT from ``year()`` and
HUGEINT from ``sum()``; both are cast to the Spark result types.
"""

from __future__ import annotations

# -- base CTEs ----------------------------------------------------------------------

_CLEAN = """
clean_mart AS (
  SELECT CAST(year(d) AS INTEGER) AS year_creation,
         CAST(month(d) AS INTEGER) AS mth_creation,
         d AS dt_creation,
         NAME,
         CAST(count(*) AS BIGINT) AS "Count"
  FROM (
    SELECT CAST(o.o_orderdate AS DATE) AS d, trim(c.c_mktsegment) AS NAME
    FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
    WHERE trim(o.o_orderpriority) <> '5-LOW' AND o.o_orderdate IS NOT NULL
  ) t
  GROUP BY ALL
)"""

_DIRTY = """
dirty_status(ID, NAME) AS (
  VALUES (0, ' New '), (1, 'Under Review'), (2, 'Escalated'), (3, 'Closed - Accepted'),
         (4, 'Closed - Rejected'), (5, 'Closed'), (6, 'closed (legacy)')
),
dirty_fact AS (
  SELECT o_orderkey AS alert_id,
         CAST(o_custkey % 8 AS INTEGER) AS WW_STATUS_ID,
         CASE WHEN o_orderkey % 97 = 0 THEN 'not a date'
              ELSE ' ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' ' END
           AS WW_CREATION_TIMESTAMP,
         CASE WHEN o_orderpriority = '5-LOW' THEN ' SUSPICIOUS ACTIVITY '
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
              ELSE o_orderpriority END AS WW_DOMAIN_CODE
  FROM orders
),
dirty_mart AS (
  SELECT CAST(year(d) AS INTEGER) AS year_creation,
         CAST(month(d) AS INTEGER) AS mth_creation,
         d AS dt_creation,
         NAME,
         CAST(count(*) AS BIGINT) AS "Count"
  FROM (
    SELECT CAST(try_strptime(trim(f.WW_CREATION_TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS DATE) AS d,
           trim(s.NAME) AS NAME
    FROM dirty_fact f LEFT JOIN dirty_status s ON f.WW_STATUS_ID = s.ID
    WHERE trim(f.WW_DOMAIN_CODE) <> 'SUSPICIOUS ACTIVITY'
  ) t
  WHERE d IS NOT NULL
  GROUP BY ALL
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def _src(kind: str, where: str | None = None) -> tuple[str, str]:
    """(CTE prefix, relation) for the clean or dirty mart, optionally filtered."""
    base, cte = ("clean_mart", _CLEAN) if kind == "clean" else ("dirty_mart", _DIRTY)
    rel = base if where is None else f"(SELECT * FROM {base} WHERE {where})"
    return _with(cte), rel


_LABEL = "strftime(make_date(year_creation, mth_creation, 1), '%b') || ' ' || CAST(year_creation AS VARCHAR)"
_FULL_MONTH = "strftime(make_date(2000, mth_creation, 1), '%B')"


def _fmt(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


# -- metrics ------------------------------------------------------------------------

def _kpis(kind: str, where: str | None = None, null_label: str | None = None) -> str:
    pre, rel = _src(kind, where)
    if null_label is not None:
        rel = (f"(SELECT year_creation, mth_creation, dt_creation, "
               f"coalesce(NAME, '{null_label}') AS NAME, \"Count\" FROM {rel})")
    return pre + f"""
SELECT total_alerts, open_alerts, closed_alerts, escalated_alerts,
       CASE WHEN total_alerts = 0 THEN 0.0
            ELSE round(CAST(closed_alerts AS DOUBLE) / CAST(total_alerts AS DOUBLE) * 100.0, 1) END
         AS closure_rate,
       CASE WHEN total_alerts = 0 THEN 0.0
            ELSE round(CAST(escalated_alerts AS DOUBLE) / CAST(total_alerts AS DOUBLE) * 100.0, 1) END
         AS escalation_rate
FROM (
  SELECT CAST(coalesce(sum("Count"), 0) AS BIGINT) AS total_alerts,
         CAST(coalesce(sum(CASE WHEN NOT starts_with(NAME, 'Closed') THEN "Count" END), 0) AS BIGINT)
           AS open_alerts,
         CAST(coalesce(sum(CASE WHEN starts_with(NAME, 'Closed') THEN "Count" END), 0) AS BIGINT)
           AS closed_alerts,
         CAST(coalesce(sum(CASE WHEN NAME = 'Escalated' THEN "Count" END), 0) AS BIGINT)
           AS escalated_alerts
  FROM {rel}
) k"""


def _status_distribution(kind: str) -> str:
    pre, rel = _src(kind)
    return pre + f'SELECT NAME, CAST(sum("Count") AS BIGINT) AS "Count" FROM {rel} GROUP BY NAME'


def _trend_total(kind: str) -> str:
    pre, rel = _src(kind)
    return pre + f"""
SELECT year_creation, mth_creation, CAST(sum("Count") AS BIGINT) AS "Count",
       {_LABEL} AS period_label,
       CAST(year_creation * 100 + mth_creation AS INTEGER) AS period_order
FROM {rel} GROUP BY ALL"""


def _trend_compare(kind: str) -> str:
    pre, rel = _src(kind)
    return pre + f"""
SELECT NAME, year_creation, mth_creation, CAST(sum("Count") AS BIGINT) AS "Count",
       {_LABEL} AS period_label,
       CAST(year_creation * 100 + mth_creation AS INTEGER) AS period_order
FROM {rel} GROUP BY ALL"""


def _trend_compare_dense(kind: str) -> str:
    pre, rel = _src(kind)
    return pre.rstrip("\n") + f""",
s AS (SELECT NAME, year_creation, mth_creation, sum("Count") AS c FROM {rel} GROUP BY ALL),
per_name AS (SELECT NAME,
                    unnest((SELECT list(DISTINCT year_creation * 100 + mth_creation) FROM s)) AS ym
             FROM (SELECT DISTINCT NAME FROM s) n),
grid AS (SELECT NAME, CAST(ym // 100 AS INTEGER) AS year_creation,
                CAST(ym % 100 AS INTEGER) AS mth_creation FROM per_name)
SELECT g.NAME, g.year_creation, g.mth_creation, CAST(coalesce(s.c, 0) AS BIGINT) AS "Count",
       strftime(make_date(g.year_creation, g.mth_creation, 1), '%b') || ' '
         || CAST(g.year_creation AS VARCHAR) AS period_label,
       CAST(g.year_creation * 100 + g.mth_creation AS INTEGER) AS period_order
FROM grid g LEFT JOIN s
  ON s.NAME IS NOT DISTINCT FROM g.NAME AND s.year_creation = g.year_creation
 AND s.mth_creation = g.mth_creation"""


def _yearly_breakdown(kind: str) -> str:
    pre, rel = _src(kind)
    return pre + f"""
SELECT NAME, year_creation, CAST(sum("Count") AS BIGINT) AS "Count" FROM {rel} GROUP BY ALL"""


def _yearly_dense(kind: str) -> str:
    pre, rel = _src(kind)
    return pre.rstrip("\n") + f""",
s AS (SELECT NAME, year_creation, sum("Count") AS c FROM {rel} GROUP BY ALL),
grid AS (SELECT NAME, unnest((SELECT list(DISTINCT year_creation) FROM s)) AS year_creation
         FROM (SELECT DISTINCT NAME FROM s) n)
SELECT g.NAME, CAST(g.year_creation AS INTEGER) AS year_creation,
       CAST(coalesce(s.c, 0) AS BIGINT) AS "Count"
FROM grid g
LEFT JOIN s ON s.NAME IS NOT DISTINCT FROM g.NAME AND s.year_creation = g.year_creation"""


# -- insights -----------------------------------------------------------------------

def _insight_select(items_cte: str, prefix: str) -> str:
    return prefix.rstrip("\n") + "," + items_cte + """
SELECT CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS rank, kind,
       CAST(subject AS VARCHAR) AS subject, CAST(value AS BIGINT) AS value,
       CAST(text AS VARCHAR) AS text
FROM items"""


def _trend_total_insights(kind: str, where: str | None = None) -> str:
    pre, rel = _src(kind, where)
    items = f"""
m AS (SELECT {_LABEL} AS label, year_creation * 100 + mth_creation AS ord,
             CAST(sum("Count") AS BIGINT) AS c
      FROM {rel} GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(c) AS a FROM m),
pk AS (SELECT label, c FROM m ORDER BY c DESC, ord ASC LIMIT 1),
fi AS (SELECT label, c FROM m ORDER BY ord ASC LIMIT 1),
la AS (SELECT label, c FROM m ORDER BY ord DESC LIMIT 1),
items AS (
  SELECT 0 AS pos, 'empty' AS kind, NULL AS subject, NULL AS value,
         'No trend insight available.' AS text FROM st WHERE n = 0
  UNION ALL
  SELECT 1, 'peak_period', pk.label, pk.c,
         'Peak workload period: ' || pk.label || ' recorded the highest total with '
           || {_fmt('pk.c')} || ' alerts.' FROM pk
  UNION ALL
  SELECT 2, 'direction', fi.label || ' to ' || la.label, la.c - fi.c,
         'Trend direction: selected alert volume '
           || CASE WHEN la.c - fi.c >= 0 THEN 'increased' ELSE 'decreased' END
           || ' by ' || {_fmt('abs(la.c - fi.c)')} || ' from ' || fi.label || ' to ' || la.label || '.'
  FROM fi, la, st WHERE st.n > 1
  UNION ALL
  SELECT 3, 'average', NULL, CAST(round_even(st.a, 0) AS BIGINT),
         'Average monthly workload across the selected period is '
           || {_fmt('round_even(st.a, 0)')} || ' alerts.'
  FROM st WHERE st.n > 1
)"""
    return _insight_select(items, pre)


def _trend_compare_insights(kind: str, null_label: str | None = None) -> str:
    pre, rel = _src(kind)
    if null_label is not None:
        rel = (f"(SELECT year_creation, mth_creation, dt_creation, "
               f"coalesce(NAME, '{null_label}') AS NAME, \"Count\" FROM {rel})")
    items = f"""
s AS (SELECT NAME, CAST(sum("Count") AS BIGINT) AS c FROM {rel} GROUP BY NAME),
r AS (SELECT NAME, c, row_number() OVER (ORDER BY c DESC, NAME ASC) AS rk
      FROM s WHERE NAME IS NOT NULL),
tot AS (SELECT count(*) AS n FROM s),
items AS (
  SELECT 0 AS pos, 'empty' AS kind, NULL AS subject, NULL AS value,
         'No trend insight available.' AS text FROM tot WHERE n = 0
  UNION ALL
  SELECT rk, 'top_contributor', NAME, c,
         'Top ' || rk || ' trend contributor: ' || NAME || ' accounts for ' || {_fmt('c')}
           || ' alerts in the selected period.' FROM r WHERE rk <= 3
  UNION ALL
  SELECT 4, 'leader_gap', a.NAME, a.c - b.c,
         'Comparison signal: ' || a.NAME || ' leads the next selected status by '
           || {_fmt('a.c - b.c')} || ' alerts.'
  FROM r a JOIN r b ON a.rk = 1 AND b.rk = 2
)"""
    return _insight_select(items, pre)


def _status_insights(kind: str, where: str | None = None) -> str:
    pre, rel = _src(kind, where)
    items = f"""
s AS (SELECT NAME, CAST(sum("Count") AS BIGINT) AS c FROM {rel} GROUP BY NAME),
t AS (SELECT sum(c) AS total,
             coalesce(sum(CASE WHEN starts_with(coalesce(NAME, 'None'), 'Closed') THEN c END), 0) AS closed,
             coalesce(sum(CASE WHEN NOT starts_with(coalesce(NAME, 'None'), 'Closed') THEN c END), 0) AS open
      FROM s),
r AS (SELECT NAME, c, row_number() OVER (ORDER BY c DESC, NAME ASC NULLS FIRST) AS rk FROM s),
items AS (
  SELECT 0 AS pos, 'empty' AS kind, NULL AS subject, NULL AS value,
         'No status insight available.' AS text FROM t WHERE total IS NULL
  UNION ALL
  SELECT rk, 'top_status', NAME, c,
         'Top ' || rk || ' status: ' || coalesce(NAME, 'None') || ' contributes ' || {_fmt('c')}
           || ' alerts (' || printf('%.1f', round(CAST(c AS DOUBLE) / CAST(t.total AS DOUBLE) * 100.0, 1))
           || '% of selected workload).'
  FROM r, t WHERE rk <= 3
  UNION ALL
  SELECT 4, 'signal', CASE WHEN open > closed THEN 'backlog' ELSE 'throughput' END, open - closed,
         CASE WHEN open > closed
              THEN 'Operational signal: open-stage alerts exceed closed-stage alerts, which may indicate backlog pressure.'
              ELSE 'Operational signal: closed-stage alerts remain higher than open-stage alerts, suggesting stronger completion throughput.'
         END
  FROM t WHERE total IS NOT NULL
)"""
    return _insight_select(items, pre)


def _yearly_insights(kind: str, where: str | None = None, positive_only: bool = False) -> str:
    pre, rel = _src(kind, where)
    jump_cond = " AND j.change > 0" if positive_only else ""
    items = f"""
y AS (SELECT year_creation AS yr, CAST(sum("Count") AS BIGINT) AS c FROM {rel} GROUP BY 1),
g AS (SELECT yr, c - lag(c) OVER (ORDER BY yr) AS change FROM y),
st AS (SELECT count(*) AS n FROM y),
tp AS (SELECT yr, c FROM y ORDER BY c DESC, yr ASC LIMIT 1),
fi AS (SELECT yr, c FROM y ORDER BY yr ASC LIMIT 1),
la AS (SELECT yr, c FROM y ORDER BY yr DESC LIMIT 1),
j AS (SELECT yr, change FROM g WHERE change IS NOT NULL ORDER BY change DESC, yr ASC LIMIT 1),
items AS (
  SELECT 0 AS pos, 'empty' AS kind, NULL AS subject, NULL AS value,
         'No yearly insight available.' AS text FROM st WHERE n = 0
  UNION ALL
  SELECT 1, 'highest_year', CAST(tp.yr AS VARCHAR), tp.c,
         'Highest year: ' || tp.yr || ' recorded the largest total with ' || {_fmt('tp.c')}
           || ' alerts.' FROM tp
  UNION ALL
  SELECT 2, 'long_term', fi.yr || ' to ' || la.yr, la.c - fi.c,
         'Long-term direction: yearly workload '
           || CASE WHEN la.c - fi.c >= 0 THEN 'increased' ELSE 'decreased' END
           || ' by ' || {_fmt('abs(la.c - fi.c)')} || ' from ' || fi.yr || ' to ' || la.yr || '.'
  FROM fi, la, st WHERE st.n > 1
  UNION ALL
  SELECT 3, 'biggest_jump', CAST(j.yr AS VARCHAR), j.change,
         'Biggest year-on-year jump: ' || j.yr || ' rose by ' || {_fmt('j.change')}
           || ' versus the previous year.'
  FROM j, st WHERE st.n > 1{jump_cond}
)"""
    return _insight_select(items, pre)


# -- explorer -----------------------------------------------------------------------

def _drilldown(kind: str, where: str | None, month_fmt: str) -> str:
    pre, rel = _src(kind, where)
    return pre + f"""
SELECT CAST(CASE WHEN GROUPING(year_creation) = 1 THEN 1
                 WHEN GROUPING(mth_creation) = 1 THEN 2
                 WHEN GROUPING(dt_creation) = 1 THEN 3 ELSE 4 END AS INTEGER) AS level,
       NAME, year_creation, mth_creation,
       strftime(make_date(2000, mth_creation, 1), '{month_fmt}') AS month_label,
       strftime(dt_creation, '%Y-%m-%d') AS date,
       CAST(sum("Count") AS BIGINT) AS total_count
FROM {rel}
GROUP BY GROUPING SETS ((NAME), (NAME, year_creation), (NAME, year_creation, mth_creation),
                        (NAME, year_creation, mth_creation, dt_creation))"""


def _export_rows(kind: str, null_label: str | None) -> str:
    pre, rel = _src(kind)
    name = "NAME" if null_label is None else f"coalesce(NAME, '{null_label}')"
    return pre + f"""
SELECT {name} AS n, year_creation AS y, mth_creation AS m,
       strftime(dt_creation, '%Y-%m-%d') AS d, "Count" AS c
FROM {rel}"""


def _mart(kind: str, where: str | None = None) -> str:
    pre, rel = _src(kind, where)
    return pre + f"SELECT * FROM {rel}"


_FANOUT = """
SELECT CAST(year(d) AS INTEGER) AS year_creation, CAST(month(d) AS INTEGER) AS mth_creation,
       d AS dt_creation, NAME, CAST(count(*) AS BIGINT) AS "Count"
FROM (
  SELECT CAST(o.o_orderdate AS DATE) AS d, trim(n.n_name) AS NAME
  FROM orders o LEFT JOIN nation n ON o.o_custkey % 7 = n.n_regionkey
  WHERE trim(o.o_orderpriority) <> '5-LOW' AND o.o_orderdate IS NOT NULL
) t
GROUP BY ALL"""

_HOT = """
SELECT CAST(year(d) AS INTEGER) AS year_creation, CAST(month(d) AS INTEGER) AS mth_creation,
       d AS dt_creation, NAME, CAST(count(*) AS BIGINT) AS "Count"
FROM (
  SELECT CAST(o.o_orderdate AS DATE) AS d, trim(c.c_mktsegment) AS NAME
  FROM orders o
  LEFT JOIN customer c
    ON (CASE WHEN o.o_orderkey % 3 = 0 THEN 1 ELSE o.o_custkey END) = c.c_custkey
  WHERE trim(o.o_orderpriority) <> '5-LOW' AND o.o_orderdate IS NOT NULL
) t
GROUP BY ALL"""

_STREAM = """
SELECT CAST(year(d) AS INTEGER) AS year_creation, CAST(month(d) AS INTEGER) AS mth_creation,
       d AS dt_creation, NAME, CAST(count(*) AS BIGINT) AS "Count"
FROM (SELECT CAST(ts AS DATE) AS d, trim(event_type) AS NAME FROM events WHERE ts IS NOT NULL) t
GROUP BY ALL"""

# A day is final once max(event time) - 2 days has passed its end.
_STREAM_APPEND = _STREAM.replace(
    "GROUP BY ALL",
    "WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY\nGROUP BY ALL")

_D = _with(_DIRTY)
_C = _with(_CLEAN)



def _quality(where: str) -> str:
    return _D + f"""
SELECT CAST(count(*) AS BIGINT) AS rows_read,
       CAST(count(*) FILTER (NOT kept) AS BIGINT) AS dropped_domain,
       CAST(count(*) FILTER (kept AND raw IS NULL) AS BIGINT) AS null_timestamp,
       CAST(count(*) FILTER (kept AND raw IS NOT NULL AND ts IS NULL) AS BIGINT) AS unparseable,
       CAST(count(*) FILTER (kept AND ts IS NOT NULL) AS BIGINT) AS counted,
       CAST(count(*) FILTER (kept AND ts IS NOT NULL AND ID IS NULL) AS BIGINT) AS unmatched_id
FROM (SELECT coalesce(trim(f.WW_DOMAIN_CODE) <> 'SUSPICIOUS ACTIVITY', false) AS kept,
             f.WW_CREATION_TIMESTAMP AS raw, s.ID,
             try_strptime(trim(f.WW_CREATION_TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts
      FROM dirty_fact f LEFT JOIN dirty_status s ON f.WW_STATUS_ID = s.ID)
WHERE {where}"""


ORACLE_SQL: dict[str, str] = {
    "normalized_headers": _D + """
SELECT alert_id, WW_STATUS_ID, WW_CREATION_TIMESTAMP, WW_DOMAIN_CODE FROM dirty_fact""",
    "filtered_alerts": _D + """
SELECT alert_id, WW_STATUS_ID, WW_DOMAIN_CODE FROM dirty_fact
WHERE trim(WW_DOMAIN_CODE) <> 'SUSPICIOUS ACTIVITY'""",
    "parsed_timestamps": _D + """
SELECT alert_id, try_strptime(trim(WW_CREATION_TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS creation_ts
FROM dirty_fact""",
    "joined_alerts": """
SELECT o.o_orderkey AS alert_id, o.o_custkey AS WW_STATUS_ID, trim(c.c_mktsegment) AS NAME
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""",
    "joined_alerts_dirty": _D + """
SELECT f.alert_id, f.WW_STATUS_ID, trim(s.NAME) AS NAME
FROM dirty_fact f LEFT JOIN dirty_status s ON f.WW_STATUS_ID = s.ID""",
    "duplicate_status_ids": """
SELECT c_nationkey AS ID, CAST(count(*) AS BIGINT) AS n_rows FROM customer
GROUP BY c_nationkey HAVING count(*) > 1""",
    "daily_mart": _mart("clean"),
    "daily_mart_dirty": _mart("dirty"),
    "daily_mart_shuffle": _mart("clean"),
    "daily_mart_years": _mart("clean", "year_creation IN (1996, 1997)"),
    "daily_mart_refreshed": _mart("clean"),
    "mart_fanout": _FANOUT,
    "mart_quality": _quality("true"),
    "mart_quality_years": _quality("year(ts) IN (1996, 1997)"),
    "mart_absorbed": _mart("clean"),
    "mart_versions": _C + """
SELECT *, 'after' AS seen FROM clean_mart
UNION ALL SELECT *, 'before' AS seen FROM clean_mart WHERE year_creation IN (1996, 1997)""",
    "mart_of_month_first": _mart("clean"),
    "mart_of_mixed_layouts": _mart("clean"),
    "layout_votes": """
WITH t AS (SELECT strftime(o_orderdate, '%m/%d/%Y %H:%M:%S') AS text FROM orders)
SELECT * FROM (
  SELECT 'MM/dd/yyyy HH:mm:ss[.SSSSSSSSS]' AS layout, count(try_strptime(text, '%m/%d/%Y %H:%M:%S')) AS votes FROM t
  UNION ALL SELECT 'dd/MM/yyyy HH:mm:ss[.SSSSSSSSS]', count(try_strptime(text, '%d/%m/%Y %H:%M:%S')) FROM t)
WHERE votes > 0""",
    "joined_alerts_hot": """
SELECT o.o_orderkey AS alert_id, CASE WHEN o.o_orderkey % 3 = 0 THEN 1 ELSE o.o_custkey END AS WW_STATUS_ID,
       trim(c.c_mktsegment) AS NAME
FROM orders o LEFT JOIN customer c
  ON c.c_custkey = CASE WHEN o.o_orderkey % 3 = 0 THEN 1 ELSE o.o_custkey END""",
    "stream_mart_append_joined": _mart("clean", """dt_creation + INTERVAL 1 DAY <=
      (SELECT max(o_orderdate) FROM orders WHERE trim(o_orderpriority) <> '5-LOW') - INTERVAL 2 DAY"""),
    "stream_mart_new_statuses": _mart("clean"),
    "mart_of_dates": _mart("clean"),
    "mart_of_zoned": _mart("clean"),
    "mart_of_layouts": _mart("clean"),
    "stored_kpis": _kpis("dirty", "year_creation IN (1996, 1997)"),
    "stored_drilldown": _drilldown("dirty", None, "%B"),
    "stream_mart_joined": _mart("clean"),
    "mart_hot_status": _HOT,
    "events_daily_mart": _STREAM,
    "stream_daily_mart": _STREAM,
    "stream_daily_mart_append": _STREAM_APPEND,
    "filter_names": _mart("dirty", "NAME IN ('New', 'Escalated')"),
    "filter_years": _mart("clean", "year_creation IN (1996, 1997)"),
    "filter_months": _mart("clean", "mth_creation IN (1, 2)"),
    "filter_combined": _mart(
        "clean", "NAME IN ('Escalated', 'BUILDING') AND year_creation IN (1996, 1997) "
                 "AND mth_creation IN (1, 2)"),
    "filter_combined_dirty": _mart(
        "dirty", "NAME IN ('Escalated', 'BUILDING') AND year_creation IN (1996, 1997) "
                 "AND mth_creation IN (1, 2)"),
    "names_totals": _D + """
SELECT NAME, CAST(sum("Count") AS BIGINT) AS total_count FROM dirty_mart GROUP BY NAME""",
    "kpis": _kpis("clean"),
    "kpis_dirty": _kpis("dirty"),
    "kpis_filtered": _kpis("dirty", "year_creation IN (1996, 1997)"),
    "kpis_static": _kpis("dirty", null_label="None"),
    "status_distribution": _status_distribution("clean"),
    "status_distribution_dirty": _status_distribution("dirty"),
    "trend_total": _trend_total("clean"),
    "trend_compare": _trend_compare("dirty"),
    "trend_compare_dense": _trend_compare_dense("dirty"),
    "trend_periods": _D + f"""
SELECT DISTINCT {_LABEL} AS period_label,
       CAST(year_creation * 100 + mth_creation AS INTEGER) AS period_order
FROM dirty_mart""",
    "yearly_breakdown": _yearly_breakdown("dirty"),
    "yearly_dense": _yearly_dense("dirty"),
    "year_totals": _C + """
SELECT year_creation, CAST(sum("Count") AS BIGINT) AS YearTotal FROM clean_mart GROUP BY 1""",
    "year_total_max": _C + """
SELECT CAST(coalesce(max(t), 0) AS BIGINT) AS max_year_total
FROM (SELECT sum("Count") AS t FROM clean_mart GROUP BY year_creation) y""",
    "available_years": _D + """
SELECT DISTINCT year_creation FROM dirty_mart WHERE NAME IN ('Escalated', 'New')""",
    "available_months": _D + f"""
SELECT DISTINCT {_FULL_MONTH} AS label, mth_creation AS value FROM dirty_mart
WHERE NAME = 'Escalated' AND year_creation = 2001""",
    "yoy_change": _C + """
SELECT year_creation, "Count", prev, CAST("Count" - prev AS BIGINT) AS change
FROM (
  SELECT year_creation, CAST(sum("Count") AS BIGINT) AS "Count",
         CAST(lag(sum("Count")) OVER (ORDER BY year_creation) AS BIGINT) AS prev
  FROM clean_mart GROUP BY year_creation
) y
WHERE prev IS NOT NULL""",
    "top3_statuses": _D + """
SELECT CAST(rk AS INTEGER) AS rank, NAME, c AS "Count"
FROM (
  SELECT NAME, CAST(sum("Count") AS BIGINT) AS c,
         row_number() OVER (ORDER BY sum("Count") DESC, NAME ASC NULLS FIRST) AS rk
  FROM dirty_mart GROUP BY NAME
) r
WHERE rk <= 3""",
    "status_share": _D + """
SELECT NAME, CAST(sum("Count") AS BIGINT) AS "Count",
       CAST(sum("Count") AS DOUBLE) / (SELECT CAST(sum("Count") AS DOUBLE) FROM dirty_mart) * 100.0
         AS share_pct
FROM dirty_mart GROUP BY NAME""",
    "peak_period": _D + f"""
SELECT year_creation, mth_creation, CAST(sum("Count") AS BIGINT) AS "Count",
       {_LABEL} AS period_label,
       CAST(year_creation * 100 + mth_creation AS INTEGER) AS period_order
FROM dirty_mart GROUP BY ALL
ORDER BY "Count" DESC, period_order ASC LIMIT 1""",
    "peak_year": _C + """
SELECT year_creation, CAST(sum("Count") AS BIGINT) AS "Count" FROM clean_mart
GROUP BY year_creation ORDER BY "Count" DESC, year_creation ASC LIMIT 1""",
    "explorer_years": _C + """
SELECT CAST(year_creation AS BIGINT) AS year, CAST(sum("Count") AS BIGINT) AS total_count
FROM clean_mart WHERE NAME = 'BUILDING' GROUP BY 1""",
    "explorer_years_all": _D + """
SELECT CAST(year_creation AS BIGINT) AS year, CAST(sum("Count") AS BIGINT) AS total_count
FROM dirty_mart GROUP BY 1""",
    "explorer_months": _D + f"""
SELECT {_FULL_MONTH} AS month, mth_creation AS month_number,
       CAST(sum("Count") AS BIGINT) AS total_count
FROM dirty_mart WHERE NAME = 'Escalated' AND year_creation = 1996 GROUP BY ALL""",
    "explorer_dates": _D + """
SELECT strftime(dt_creation, '%Y-%m-%d') AS date, CAST(sum("Count") AS BIGINT) AS total_count
FROM dirty_mart WHERE NAME = 'Escalated' AND year_creation = 1996 AND mth_creation = 3
GROUP BY 1""",
    "drilldown": _drilldown("dirty", None, "%B"),
    "drilldown_filtered": _drilldown("dirty", "NAME IN ('Escalated', 'New')", "%b"),
    "insight_trend_total": _trend_total_insights("clean"),
    "insight_trend_total_filtered": _trend_total_insights(
        "dirty", "NAME = 'Closed' AND year_creation IN (1999, 2000)"),
    "insight_trend_compare": _trend_compare_insights("dirty"),
    "insight_trend_compare_static": _trend_compare_insights("dirty", "None"),
    "insight_status": _status_insights("dirty"),
    "insight_status_clean": _status_insights("clean"),
    "insight_status_empty": _status_insights("dirty", "NAME = 'no such status'"),
    "insight_yearly": _yearly_insights("clean"),
    "insight_yearly_static": _yearly_insights(
        "clean", "year_creation IN (2000, 2001)", positive_only=True),
    "export_rows": _export_rows("dirty", None),
    "export_rows_static": _export_rows("dirty", "None"),
    "export_names": _D + """
SELECT DISTINCT NAME AS name FROM dirty_mart WHERE NAME IS NOT NULL""",
    "export_years": _C + """
SELECT DISTINCT year_creation AS year FROM clean_mart""",
    "export_months": _C + f"""
SELECT DISTINCT mth_creation AS value, {_FULL_MONTH} AS label FROM clean_mart""",
    "export_summary": _D + """
SELECT CAST(count(DISTINCT NAME) AS BIGINT) AS n_names,
       CAST(count(DISTINCT year_creation) AS BIGINT) AS n_years,
       CAST(count(*) AS BIGINT) AS n_rows
FROM dirty_mart""",
}

ORACLE_SQL["stored_explorer_dates"] = ORACLE_SQL["explorer_dates"]

"""Constants passed to the operators.

Everything under "Fixed values" must stay equal to the behaviour being
reproduced (names, texts, formats); everything else is a tuning knob.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the reproduced application's values)
# ---------------------------------------------------------------------------

# Business domain dropped before anything is counted.
EXCLUDED_DOMAIN = "SUSPICIOUS ACTIVITY"

# A status is "closed" when its name starts with this prefix (case-sensitive).
CLOSED_PREFIX = "Closed"

# The one status name counted as escalated (exact, case-sensitive).
ESCALATED_NAME = "Escalated"

# Required input columns and the file labels used in the validation error.
FACT_REQUIRED = ("WW_STATUS_ID", "WW_CREATION_TIMESTAMP", "WW_DOMAIN_CODE")
DIM_REQUIRED = ("ID", "NAME")
FACT_LABEL = "alert_header.parquet"
DIM_LABEL = "workflow_statuses.parquet"

# Selection values that mean "no filter".
NO_FILTER_VALUES = (None, "", "ALL")

# Insight texts; the %d / %s marks are filled by Spark's format_string.
TEXT_NO_TREND = "No trend insight available."
TEXT_NO_STATUS = "No status insight available."
TEXT_NO_YEARLY = "No yearly insight available."
TEXT_TOP_CONTRIBUTOR = "Top %d trend contributor: %s accounts for %s alerts in the selected period."
TEXT_LEADER_GAP = "Comparison signal: %s leads the next selected status by %s alerts."
TEXT_PEAK_PERIOD = "Peak workload period: %s recorded the highest total with %s alerts."
TEXT_TREND_DIRECTION = "Trend direction: selected alert volume %s by %s from %s to %s."
TEXT_STATIC_TREND_DIRECTION = "Trend direction: alert volume %s by %s from %s to %s."
TEXT_AVERAGE = "Average monthly workload across the selected period is %s alerts."
TEXT_TOP_STATUS = "Top %d status: %s contributes %s alerts (%s%% of selected workload)."
TEXT_BACKLOG = "Operational signal: open-stage alerts exceed closed-stage alerts, which may indicate backlog pressure."  # noqa: E501
TEXT_THROUGHPUT = "Operational signal: closed-stage alerts remain higher than open-stage alerts, suggesting stronger completion throughput."  # noqa: E501
TEXT_HIGHEST_YEAR = "Highest year: %d recorded the largest total with %s alerts."
TEXT_LONG_TERM = "Long-term direction: yearly workload %s by %s from %d to %d."
TEXT_BIGGEST_JUMP = "Biggest year-on-year jump: %d rose by %s versus the previous year."
WORD_INCREASED = "increased"
WORD_DECREASED = "decreased"

# Text used for a null status name by the static export (Python's str(None)).
NONE_TEXT = "None"

# ---------------------------------------------------------------------------
# Our own choices
# ---------------------------------------------------------------------------

# Every character with the Unicode White_Space property; stripped from both
# ends of domain codes, names and raw timestamps (plain SQL trim only removes
# spaces and would keep tabs and newlines).
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Accepted layouts for string creation timestamps, tried in order per row
# (first match wins, so day/month ambiguity resolves to the earlier layout).
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]XX",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss[.SSSSSSSSS]",
    "yyyy/MM/dd'T'HH:mm:ss[.SSSSSSSSS]",
    "yyyy/MM/dd HH:mm",
    "yyyy/MM/dd",
    "yyyy/M/d",
    "dd/MM/yyyy HH:mm:ss[.SSSSSSSSS]",
    "dd/MM/yyyy HH:mm",
    "dd/MM/yyyy",
    "dd-MM-yyyy HH:mm:ss[.SSSSSSSSS]",
    "dd-MM-yyyy HH:mm",
    "dd-MM-yyyy",
    "yyyyMMdd",
    "yyyyMMdd'T'HHmmss",
    "yyyyMMdd HHmmss",
)

# Layouts that only stand for election against the ones above (day and month swapped): per row
# alone they would turn the same text into two different days.
MONTH_FIRST_FORMATS = (
    "MM/dd/yyyy HH:mm:ss[.SSSSSSSSS]",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
    "MM-dd-yyyy HH:mm:ss[.SSSSSSSSS]",
    "MM-dd-yyyy HH:mm",
    "MM-dd-yyyy",
)

# The status dimension is broadcast only when it provably holds at most this
# many rows (checked with a bounded count); beyond it the fact is
# pre-aggregated per (status id, day) and joined with a shuffle.
BROADCAST_MAX_ROWS = 200_000
# ... and when its rows total at most this many bytes (ids plus name text).
BROADCAST_MAX_BYTES = 64 * 1024 * 1024

# In a row-level join with a larger dimension, a status id with over one HOT_IDS-th of the alerts is
# hot: there are fewer than HOT_IDS such ids, and their rows are joined without a shuffle.
HOT_IDS = 200

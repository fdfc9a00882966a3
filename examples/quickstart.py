"""Quick start: the dashboard surface over the test tables (fixture B).

    python examples/quickstart.py [sf_dir]

Builds and stores the mart once, then shows one filter change: KPIs, the
status distribution, the insights, and the first rows of the drill-down.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from alertlens import AlertDashboard  # noqa: E402
from alertlens.session import local_session, scratch_path  # noqa: E402
from alertlens.sources import fixtures as fx  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    fact, dim = fx.dirty_fact(spark, sf_dir), fx.dirty_dim(spark)
    with AlertDashboard.from_tables(spark, fact, dim,
                                    excluded_domain=fx.DIRTY_EXCLUDED_DOMAIN) as dash:
        panels = dash.refresh(names=["Escalated", "New", "Closed"], years=[1999, 2000],
                              trend_mode="compare")
        k = panels["kpis"][0]
        print(f"total {k.total_alerts:,}  open {k.open_alerts:,}  "
              f"closure {k.closure_rate}%  escalation {k.escalation_rate}%")
        for row in panels["status_distribution"]:
            print(f"  {row.NAME}: {row.Count:,}")
        for key in ("trend_insights", "status_insights", "yearly_insights"):
            for row in sorted(panels[key], key=lambda r: r.rank):
                print(f"- {row.text}")
        for row in dash.drilldown(["Escalated"]).limit(6).collect():
            print("  " * row.level, row.NAME, row.year_creation, row.month_label, row.date,
                  row.total_count)
        out = dash.export(scratch_path(spark, "payload"))
        print("payload:", out["rows"])
    spark.stop()


if __name__ == "__main__":
    main()

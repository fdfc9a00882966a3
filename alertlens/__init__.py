"""alertlens: alert-workflow analytics as Spark DataFrame operators.

Typical use::

    from alertlens import AlertDashboard
    dash = AlertDashboard.from_paths(spark, alert_header_path, workflow_statuses_path)
    dash.kpis(names=["Escalated"], years=[2024]).show()
"""

from alertlens.operators.filters import apply_filters, normalize_selection
from alertlens.operators.mart import (
    build_mart,
    daily_mart,
    load_mart,
    materialize_mart,
    refresh_mart,
    write_mart,
)
from alertlens.plans.dashboard import AlertDashboard
from alertlens.sources.readers import SchemaError, read_alert_header, read_workflow_statuses

__all__ = [
    "AlertDashboard", "SchemaError", "apply_filters", "build_mart", "daily_mart", "load_mart",
    "materialize_mart", "normalize_selection", "read_alert_header", "read_workflow_statuses",
    "refresh_mart", "write_mart",
]

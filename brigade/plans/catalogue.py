"""All registered queries."""

from brigade.plans import (  # noqa: F401
    anomaly_queries,
    catalog_queries,
    dashboard_queries,
    io_queries,
    kpi_queries,
    service_queries,
    stream_queries,
    whole_queries,
)
from brigade.plans.registry import QUERIES, SQL, runnable  # noqa: F401

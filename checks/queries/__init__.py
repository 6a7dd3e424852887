"""All registered queries."""

from checks.registry import ORACLES, QUERIES  # noqa: F401
from checks.queries import (  # noqa: F401
    compliance, contents, dashboard, detection, expressions, full_scan, intel, manifests, remediation, reports, scoring, storage,
    streams,
)

"""Sources and sinks: table readers, test-data adapters, report writers."""

from meterwise.sources.tables import SourceTables, read_account_monthly, read_usage_lines
from meterwise.sources.adapters import account_monthly, usage_lines
from meterwise.sources.sinks import write_report

__all__ = [
    "SourceTables",
    "read_account_monthly",
    "read_usage_lines",
    "account_monthly",
    "usage_lines",
    "write_report",
]

"""Functional dependencies of tables, found and checked with Spark."""

from determina.operators.checks import check_fds, violations
from determina.operators.classes import as_text
from determina.plans.discover import discover_fds, discover_fds_by_count, discover_fds_in_parts
from determina.plans.group_search import discover_fds_by_groups
from determina.plans.two_ended import discover_fds_from_both_ends
from determina.sources.delimited import (
    fd_lines,
    line_widths,
    read_delimited,
    read_split_lines,
    write_fds,
)

__all__ = [
    "as_text",
    "check_fds",
    "discover_fds",
    "discover_fds_by_count",
    "discover_fds_by_groups",
    "discover_fds_from_both_ends",
    "discover_fds_in_parts",
    "fd_lines",
    "line_widths",
    "read_delimited",
    "read_split_lines",
    "violations",
    "write_fds",
]

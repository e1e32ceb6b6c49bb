"""Compare, report, load and migrate tables as Spark DataFrame work."""

from .operators.columns import (
    accepted_key,
    best_candidate,
    column_widths,
    profile_uniqueness,
    unique_column,
)
from .operators.mutate import mutate, number_text, pick, template
from .plans.compare import Diff, compare
from .plans.gate import write_if_changed
from .plans.migrate import migrate, migrate_jdbc
from .plans.report import write_files, write_json, write_report
from .sources.files import LoadResult, first_rows, load_files, with_row_index
from .sources.tables import (
    constraints,
    declare_key,
    declare_unique,
    declared_key,
    discover_key,
    replace_table,
    select,
    show_tables,
    use_database,
    write_table,
)

__all__ = [
    "Diff",
    "LoadResult",
    "accepted_key",
    "best_candidate",
    "column_widths",
    "compare",
    "constraints",
    "declare_key",
    "declare_unique",
    "declared_key",
    "discover_key",
    "first_rows",
    "load_files",
    "migrate",
    "migrate_jdbc",
    "mutate",
    "number_text",
    "pick",
    "profile_uniqueness",
    "replace_table",
    "select",
    "show_tables",
    "template",
    "unique_column",
    "use_database",
    "with_row_index",
    "write_files",
    "write_if_changed",
    "write_json",
    "write_report",
    "write_table",
]

"""tablewright: repeatable table pipelines as Spark DataFrame plans."""

from .errors import TableError
from .table import Table, as_table
from .operators.columns import select_columns, rename_columns, clean_text, cast_columns
from .operators.rows import filter_rows, handle_nulls, sort_rows, limit_rows, deduplicate_rows
from .operators.combine import join_tables, union_tables
from .operators.aggregate import group_by
from .operators.profile import infer_schema, schema_list, type_census, preview, observe_counts

__all__ = [
    "TableError", "Table", "as_table",
    "select_columns", "rename_columns", "clean_text", "cast_columns",
    "filter_rows", "handle_nulls", "sort_rows", "limit_rows", "deduplicate_rows",
    "join_tables", "union_tables", "group_by",
    "infer_schema", "schema_list", "type_census", "preview", "observe_counts",
]

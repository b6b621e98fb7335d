"""Column operators: select, rename, clean text, cast.

All are projections: one ``select`` each, no shuffle, inside whole-stage
codegen.  Settings are checked against the schema before any job runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableError, require_columns, require_distinct
from ..functions import sniff as S
from ..table import C, CheckRule, Table, as_table

MAX_SAFE_INTEGER = 2 ** 53 - 1

CASE_MODES = ("unchanged", "lowercase", "uppercase")
CAST_TYPES = ("string", "integer", "number", "decimal", "double", "boolean", "date", "timestamp")
# Accepted boolean spellings (after trim, any case).
TRUE_WORDS = ("true", "1", "yes", "y", "on")
FALSE_WORDS = ("false", "0", "no", "n", "off")


def _project(table: Table, exprs: dict[str, Column], names: list[str] | None = None) -> Table:
    """Re-project visible columns (replacing some) and keep hidden ones."""
    names = names if names is not None else table.columns
    cols = [exprs[n].alias(n) if n in exprs else C(n) for n in names]
    return table.derive(table.df.select(*cols, *[C(h) for h in table.hidden]))


# -- C1 -------------------------------------------------------------------------

def select_columns(table, columns=None) -> Table:
    """Keep the listed columns in the listed order; ``None`` keeps all."""
    table = as_table(table)
    if columns is None:
        return table
    if not isinstance(columns, (list, tuple)) or not columns:
        raise TableError("NO_COLUMNS", "No column is selected.")
    names = [str(c).strip() for c in columns]
    require_columns(table.columns, names)
    require_distinct(names, "COLUMN_NAME_COLLISION", "The output column")
    return _project(table, {}, names)


# -- C2 / C2a -------------------------------------------------------------------

def rename_columns(table, mappings) -> Table:
    """Rename several columns at once; positions are kept.  A swap
    ``{a->b, b->a}`` is legal because all renames apply together."""
    table = as_table(table)
    rules = []
    for rule in mappings or []:
        src = str((rule or {}).get("from") or "").strip()
        dst = str((rule or {}).get("to") or "").strip()
        if src or dst:
            rules.append((src, dst))
    if not rules:
        return table
    require_columns(table.columns, [src for src, _ in rules])
    for src, dst in rules:
        if not (src and dst):
            raise TableError("INVALID_RENAME", f"A rename has a name on one side only: {src or dst}.")
    require_distinct([src for src, _ in rules], "INVALID_RENAME", "A new name of the column")
    renames = dict(rules)
    out = [renames.get(c, c) for c in table.columns]
    require_distinct(out, "COLUMN_NAME_COLLISION", "The output column")
    cols = [C(c).alias(n) for c, n in zip(table.columns, out)]
    return table.derive(table.df.select(*cols, *[C(h) for h in table.hidden]))


# -- C3 / C4 / C4a ---------------------------------------------------------------

def clean_text(table, columns, trim: bool = True, case_mode: str = "unchanged") -> Table:
    """Trim (JavaScript whitespace set) and/or change case of text cells.
    Non-text columns pass through untouched."""
    table = as_table(table)
    if not isinstance(columns, (list, tuple)) or not columns or case_mode not in CASE_MODES:
        raise TableError("INVALID_CLEAN_TEXT", "Cleaning takes a list of columns and one of the case modes.")
    names = [str(c) for c in columns]
    require_columns(table.columns, names)
    exprs = {}
    for name in dict.fromkeys(names):
        if not isinstance(table.dtype(name), T.StringType):
            continue
        e = C(name)
        if trim:
            e = S.js_trim(e)
        if case_mode == "lowercase":
            e = F.lower(e)
        elif case_mode == "uppercase":
            e = F.upper(e)
        exprs[name] = e
    if not exprs or (not trim and case_mode == "unchanged"):
        return table
    return _project(table, exprs)


# -- C5..C11 -----------------------------------------------------------------------

def cast_value(col: Column, dtype: T.DataType, target: str) -> tuple[Column, Column]:
    """(result, failed) for one cell cast; ``failed`` is true only for a
    non-null, non-empty input that could not be converted."""
    none = F.lit(None)
    is_text = isinstance(dtype, T.StringType)
    empty = col.isNull() | (col == "") if is_text else col.isNull()
    t = S.js_trim(col) if is_text else None

    if target == "string":
        return S.text_form(col, dtype), F.lit(False)

    if target == "integer":
        if is_text:
            ok = t.rlike(r"^[+-]?\d+(\.0+)?$")
            v = F.regexp_replace(t, r"\.0+$", "").try_cast("long")
            v = F.when(ok & v.between(-MAX_SAFE_INTEGER, MAX_SAFE_INTEGER), v)
        elif isinstance(dtype, S.INTEGRAL_TYPES):
            v = F.when(col.cast("long").between(-MAX_SAFE_INTEGER, MAX_SAFE_INTEGER), col.cast("long"))
        elif isinstance(dtype, S.FRACTIONAL_TYPES):
            d = col.cast("double")
            v = F.when((d == F.floor(d)) & (F.abs(d) <= 9.2e18), d.cast("long"))
        else:
            v = none.cast("long")
        result = F.when(empty, none.cast("long")).otherwise(v)
        return result, ~empty & result.isNull()

    if target in ("number", "decimal", "double"):
        if is_text:
            v = S.number_of_text(t)
        elif isinstance(dtype, S.NUMERIC_TYPES):
            d = col.cast("double")
            v = F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)
        else:
            v = none.cast("double")
        result = F.when(empty, none.cast("double")).otherwise(v)
        return result, ~empty & result.isNull()

    if target == "boolean":
        if is_text:
            low = F.lower(t)
            v = F.when(low.isin(*TRUE_WORDS), F.lit(True)).when(low.isin(*FALSE_WORDS), F.lit(False))
        elif isinstance(dtype, T.BooleanType):
            v = col
        elif isinstance(dtype, S.NUMERIC_TYPES):
            v = F.when(col == 1, F.lit(True)).when(col == 0, F.lit(False))
        else:
            v = none.cast("boolean")
        result = F.when(empty, none.cast("boolean")).otherwise(v)
        return result, ~empty & result.isNull()

    if target == "date":
        if is_text:
            v = F.when(S.is_real_date(t), F.try_to_date(t, "yyyy-MM-dd"))
        elif isinstance(dtype, T.DateType):
            v = col
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            v = F.to_date(col)
        else:
            v = none.cast("date")
        result = F.when(empty, none.cast("date")).otherwise(v)
        return result, ~empty & result.isNull()

    if target == "timestamp":
        if is_text:
            v = S.parse_timestamp(t)
        elif isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            v = col.cast("timestamp")
        else:
            v = none.cast("timestamp")
        result = F.when(empty, none.cast("timestamp")).otherwise(v)
        return result, ~empty & result.isNull()

    raise TableError("CAST_TYPE_UNSUPPORTED", f"There is no cast to {target}.", type=target)


def cast_columns(table, casts, failure_mode: str = "error") -> Table:
    """Convert columns to string, integer, number, boolean, date or timestamp.

    ``failure_mode='null'`` turns failures into null; ``'error'`` (default)
    adds a check that raises ``CAST_FAILED`` with the column, type and a
    failing value.  Several rules on one column all see the original value;
    the last one wins.
    """
    table = as_table(table)
    rules = []
    for rule in casts or []:
        col = str((rule or {}).get("column") or "").strip()
        typ = str((rule or {}).get("type") or "").strip().lower()
        if col or typ:
            rules.append((col, typ))
    if not rules:
        return table
    require_columns(table.columns, [c for c, _ in rules])
    mode = "null" if failure_mode == "null" else "error"
    for col, typ in rules:
        if not col or not typ:
            raise TableError("INVALID_CAST", "A cast names a column and a type.", column=col)
        if typ not in CAST_TYPES:
            raise TableError("CAST_TYPE_UNSUPPORTED", f"There is no cast to {typ}.", type=typ)
    exprs: dict[str, Column] = {}
    check_rules = []
    for col, typ in rules:
        result, failed = cast_value(C(col), table.dtype(col), typ)
        exprs[col] = result
        if mode == "error":
            check_rules.append(CheckRule("CAST_FAILED", f"Column {col} has a value that is no {typ}.", failed,
                                         S.text_form(C(col), table.dtype(col)), {"column": col, "type": typ}))
    return _project(table.checked(check_rules) if check_rules else table, exprs)

"""Row operators: filter, null handling, sort, limit, deduplicate.

Filters on typed columns with a literal of the same kind become bare
comparisons, so Catalyst pushes them into the Parquet scan.  Text columns
use the loose compare: a numeric/date/boolean literal compares by value with
cells of that kind, and everything else compares in natural text order
(case- and accent-insensitive, digit runs by value).
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableError, require_columns
from ..functions import sniff as S
from ..table import C, OrderKey, Table, as_table, hidden_name

COMPARE_OPS = ("eq", "neq", "gt", "gte", "lt", "lte")
TEXT_OPS = ("contains", "starts-with", "ends-with")
NULL_OPS = ("is-null", "not-null")
OPERATORS = COMPARE_OPS + TEXT_OPS + NULL_OPS


def _apply(op: str, a: Column, b: Column) -> Column:
    return {
        "eq": lambda: a == b, "neq": lambda: a != b, "gt": lambda: a > b,
        "gte": lambda: a >= b, "lt": lambda: a < b, "lte": lambda: a <= b,
    }[op]()


def _literal_kind(value):
    """(kind, native value, text) of a filter literal."""
    cls = S.py_class(value)
    if cls == "integer":
        # exact: a BIGINT literal must not pass through a double
        num = int(S.py_trim(value)) if isinstance(value, str) else int(value)
        return "number", num, S.py_text(num if abs(num) <= 2 ** 53 else float(num))
    if cls == "number":
        num = float(S.py_trim(value)) if isinstance(value, str) else float(value)
        return "number", num, S.py_text(num)
    if cls in ("date", "timestamp"):
        if isinstance(value, _dt.datetime):
            ts = value
        elif isinstance(value, _dt.date):
            ts = _dt.datetime(value.year, value.month, value.day)
        else:
            ts = S.py_parse_timestamp(S.py_trim(value))
        if ts is not None:
            return "date", ts, value if isinstance(value, str) else S.py_text(value)
    if cls == "boolean":
        flag = value if isinstance(value, bool) else S.py_trim(str(value)).lower() == "true"
        return "boolean", flag, "true" if flag else "false"
    return "string", None, S.py_text(value) if value is not None else "null"


def _natural_cmp(op: str, cell_text: Column, lit_text: str) -> Column:
    return _apply(op, S.natural_key(cell_text), S.natural_literal(lit_text))


def _compare_integral(col: Column, op: str, value) -> Column:
    """An integral column against any number, by an integer literal (exact and pushable)."""
    if math.isnan(value):
        return col.isNotNull() if op == "neq" else F.lit(False)
    if math.isinf(value) or not -2 ** 63 <= value < 2 ** 63:
        always = op == "neq" or op in (("lt", "lte") if value > 0 else ("gt", "gte"))
        return col.isNotNull() if always else F.lit(False)
    low = math.floor(value)
    if low == value:
        return _apply(op, col, F.lit(int(value)).cast("long"))
    if op in ("eq", "neq"):
        return F.lit(False) if op == "eq" else col.isNotNull()
    return _apply("gt" if op in ("gt", "gte") else "lte", col, F.lit(int(low)).cast("long"))


def compare_expr(col: Column, dtype: T.DataType, op: str, value) -> Column:
    """Loose comparison of a column with a literal (null cells never match)."""
    if value is None:
        return F.lit(False)
    kind, native, text = _literal_kind(value)
    if isinstance(dtype, S.NUMERIC_TYPES):
        if kind == "number":
            if isinstance(dtype, S.INTEGRAL_TYPES):
                return _compare_integral(col, op, native)
            exact = isinstance(dtype, T.DecimalType) and isinstance(native, int) and abs(native) < 10 ** 37
            return _apply(op, col, F.lit(decimal.Decimal(native) if exact else float(native)))
        return _natural_cmp(op, S.text_form(col, dtype), text)
    if isinstance(dtype, S.TIME_TYPES):
        if kind == "date":
            iso = native.isoformat(sep=" ")
            if isinstance(dtype, T.DateType):
                return _apply(op, col.cast("timestamp"), F.lit(iso).cast("timestamp"))
            return _apply(op, col, F.lit(iso).cast(dtype))
        return _natural_cmp(op, S.text_form(col, dtype), text)
    if isinstance(dtype, T.BooleanType):
        if kind == "boolean":
            return _apply(op, col, F.lit(native))
        return _natural_cmp(op, S.text_form(col, dtype), text)
    if not isinstance(dtype, T.StringType):
        return _natural_cmp(op, S.text_form(col, dtype), text)

    # text column: per-cell kind decides between value and natural compare
    if kind == "string" and op in ("eq", "neq") and not any(ch.isdigit() for ch in text):
        # A digit-free text literal can only equal digit-free cells, and then
        # natural order is plain case/accent-insensitive collation: no need
        # to classify cells.
        equal = (F.collate(col, S.COLLATION) == F.collate(F.lit(text), S.COLLATION)) & ~col.rlike(r"\d")
        return F.when(col.isNull(), F.lit(False)).otherwise(equal if op == "eq" else ~equal)
    t = S.js_trim(col)
    if kind == "string":
        # Only number and boolean cells change their text form; date and
        # timestamp cells compare by their raw text, so skip parsing them.
        cls = (F.when(t.rlike(S.BOOLEAN_PATTERN), F.lit("boolean"))
               .when((t.rlike(S.INTEGER_PATTERN) | t.rlike(S.NUMBER_PATTERN)) & ~t.rlike(S.LEADING_ZERO_PATTERN),
                     F.lit("number"))
               .otherwise(F.lit("string")))
    else:
        cls = S.text_class(col)
    num = t.try_cast("double")
    if kind == "number":
        same = cls.isin("integer", "number")
        native_cmp = _apply(op, num, F.lit(float(native)))
    elif kind == "date":
        same = cls.isin("date", "timestamp")
        native_cmp = _apply(op, S.parse_timestamp(t), F.lit(native.isoformat(sep=" ")).cast("timestamp"))
    elif kind == "boolean":
        same = cls == "boolean"
        native_cmp = _apply(op, F.lower(t) == "true", F.lit(native))
    else:
        same = F.lit(False)
        native_cmp = F.lit(False)
    cell_text = (
        F.when(cls.isin("integer", "number"), S.js_number_text(num))
        .when(cls == "boolean", F.lower(t))
        .otherwise(col)
    )
    natural = _natural_cmp(op, cell_text, text)
    return F.when(col.isNull(), F.lit(False)).when(same, native_cmp).otherwise(natural)


def condition_expr(table: Table, rule: dict) -> Column:
    name, op = rule["column"], rule["operator"]
    col, dtype = C(name), table.dtype(name)
    if op == "is-null":
        return col.isNull()
    if op == "not-null":
        return col.isNotNull()
    value = rule.get("value")
    if op in TEXT_OPS:
        text = S.py_text(value) if value is not None else "null"
        cell = S.text_form(col, dtype)
        fn = {"contains": cell.contains, "starts-with": cell.startswith, "ends-with": cell.endswith}[op]
        return fn(F.lit(text))
    if op in COMPARE_OPS:
        # No coalesce(..., false): a null result drops the row just like false
        # (the rule language has no NOT), and bare predicates reach the scan.
        return compare_expr(col, dtype, op, value)
    raise TableError("INVALID_FILTER", f"There is no filter operator {op}.", operator=op)


def filter_rows(table, conditions, combination: str = "and") -> Table:
    """Keep rows matching all (``'and'``) or any (``'or'``) rule."""
    table = as_table(table)
    rules = []
    for cond in conditions or []:
        cond = cond or {}
        rules.append({
            "column": str(cond.get("column") or "").strip(),
            "operator": str(cond.get("operator") or "").strip().lower(),
            "has_value": "value" in cond,
            "value": cond.get("value"),
        })
    if not rules:
        return table
    for rule in rules:
        needs_value = rule["operator"] not in NULL_OPS
        if not rule["column"] or not rule["operator"] or (needs_value and not rule["has_value"]):
            raise TableError("INVALID_FILTER", "A filter condition lacks its column, operator or value.",
                             column=rule["column"], operator=rule["operator"])
    require_columns(table.columns, [r["column"] for r in rules])
    for rule in rules:
        if rule["operator"] not in OPERATORS:
            raise TableError("INVALID_FILTER", f"There is no filter operator {rule['operator']}.",
                             operator=rule["operator"])
    exprs = [condition_expr(table, r) for r in rules]
    joined = reduce(lambda a, b: a | b, exprs) if str(combination).lower() == "or" else reduce(lambda a, b: a & b, exprs)
    return table.derive(table.df.filter(joined))


# -- N1..N3 ---------------------------------------------------------------------

def _replacement_expr(col: Column, dtype: T.DataType, value):
    """(expression, widened) for ``coalesce(col, value)`` keeping the column
    type when the value fits it, otherwise widening the column to text."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(col, F.lit(S.py_text(value))), False
    kind, native, _ = _literal_kind(value) if value is not None else ("null", None, None)
    if isinstance(dtype, S.NUMERIC_TYPES) and kind == "number":
        if isinstance(dtype, S.FRACTIONAL_TYPES):
            return F.coalesce(col, F.lit(float(native)).cast(dtype)), False
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(dtype)]
        if math.isfinite(native) and native == int(native) and -2 ** bits <= native < 2 ** bits:
            return F.coalesce(col, F.lit(int(native)).cast(dtype)), False
    if isinstance(dtype, T.BooleanType) and kind == "boolean":
        return F.coalesce(col, F.lit(native)), False
    if isinstance(dtype, S.TIME_TYPES) and kind == "date":
        return F.coalesce(col, F.lit(native.isoformat(sep=" ")).cast(dtype)), False
    return F.coalesce(S.text_form(col, dtype), F.lit(S.py_text(value))), True


def handle_nulls(table, mode: str, columns, replacement="") -> Table:
    """``mode='remove'`` drops rows with null in any selected column ('' is
    kept); ``mode='replace'`` fills nulls with ``replacement``."""
    table = as_table(table)
    mode = mode if mode in ("remove", "replace") else ""
    names = [str(c).strip() for c in (columns or []) if str(c).strip()] if isinstance(columns, (list, tuple)) else []
    if not mode:
        raise TableError("INVALID_NULL_HANDLING", "Nulls are either removed or replaced; the mode says neither.")
    if not names:
        raise TableError("INVALID_NULL_HANDLING", "No column is selected whose nulls are handled.")
    require_columns(table.columns, names)
    if mode == "remove":
        cond = reduce(lambda a, b: a & b, [C(n).isNotNull() for n in names])
        return table.derive(table.df.filter(cond))
    value = "" if replacement is None else replacement
    exprs = {n: _replacement_expr(C(n), table.dtype(n), value)[0] for n in dict.fromkeys(names)}
    cols = [exprs[n].alias(n) if n in exprs else C(n) for n in table.columns]
    return table.derive(table.df.select(*cols, *[C(h) for h in table.hidden]))


# -- O-1..O-5 -----------------------------------------------------------------------

def sort_rows(table, keys) -> Table:
    """Stable multi-key sort; null and '' last in both directions.

    Lazy: the keys become the table's order (prepended to any older order,
    which makes the sort stable).  The sort itself runs once, at the sink or
    under a limit (then as a top-k)."""
    table = as_table(table)
    rules = []
    for rule in keys or []:
        name = str((rule or {}).get("column") or "").strip()
        desc = str((rule or {}).get("direction") or "asc").lower() == "desc"
        if name:
            rules.append((name, desc))
    if not rules:
        return table
    require_columns(table.columns, [n for n, _ in rules])
    # The class of a text cell is a chain of patterns that every part of its key needs: one column below.
    classes = {n: hidden_name("c") for n, _ in rules if isinstance(table.dtype(n), T.StringType)}
    classed = table.df.select("*", *[S.text_class(C(n)).alias(h) for n, h in classes.items()])
    new_cols, order = [], []
    for name, desc in rules:
        cls = C(classes[name]) if name in classes else None
        for expr, is_flag in S.sort_key_fields(C(name), table.dtype(name), cls):
            hid = hidden_name("k")
            new_cols.append(expr.alias(hid))
            order.append(OrderKey(hid, desc=(desc and not is_flag), nulls_last=desc))
    df = classed.select(*[C(c) for c in table.df.columns], *new_cols)
    return table.derive(df, order=tuple(order) + table.order)


def limit_rows(table, n) -> Table:
    """First ``n`` rows in table order (a top-k when the table is ordered)."""
    table = as_table(table)
    try:
        count = float(n) if not isinstance(n, bool) else float("nan")
    except (TypeError, ValueError):
        count = float("nan")
    if not math.isfinite(count) or not count.is_integer() or count < 0:
        raise TableError("INVALID_LIMIT", "A limit is a whole number of rows, 0 or more.", value=n)
    count = int(count)
    if table.order and count:
        # a top-k looks at every row
        return table.derive(table.df.orderBy(*[k.column() for k in table.order]).limit(count))
    return table.loosened().derive(table.df.limit(count))


# -- D1 / D2 --------------------------------------------------------------------------

def deduplicate_rows(table, columns=None) -> Table:
    """Keep the first row per key (all visible columns when none given).

    Ordered tables keep the row with the smallest order value via
    ``min_by``: a sort-based aggregate (its buffer is a row) whose partial
    step runs map-side, so a hot key is collapsed before the shuffle.  Unordered tables use
    ``dropDuplicates`` (an arbitrary row per key, as there is no "first")."""
    table = as_table(table)
    keys = [str(c) for c in columns] if isinstance(columns, (list, tuple)) and columns else list(table.columns)
    require_columns(table.columns, keys)
    if not table.order:
        if not any(isinstance(table.dtype(k), T.MapType) for k in keys):
            return table.derive(table.df.dropDuplicates(keys))
        # dropDuplicates refuses map keys; grouping on them works.
        rest = [c for c in table.df.columns if c not in keys]
        if not rest:
            return table.derive(table.df.groupBy(*[C(k) for k in keys]).agg(F.count(F.lit(1)).alias("__tw_n")).drop("__tw_n"))
        any_row = hidden_name("row")
        agg = table.df.groupBy(*[C(k) for k in keys]).agg(F.first(F.struct(*[C(c) for c in rest])).alias(any_row))
        out = agg.select(*[C(k) for k in keys], *[F.col(f"`{any_row}`.`{c}`").alias(c) for c in rest])
        return table.derive(out.select(*[C(c) for c in table.df.columns]))
    table, ov = table.order_value()
    rest = [c for c in table.df.columns if c not in keys]
    ordv = hidden_name("ov")
    df = table.df.withColumn(ordv, ov)
    payload = F.struct(*[C(c) for c in rest]) if rest else F.lit(None)
    best = hidden_name("best")
    agg = df.groupBy(*[C(k) for k in keys]).agg(F.min_by(payload, C(ordv)).alias(best))
    out = agg.select(*[C(k) for k in keys], *[F.col(f"`{best}`.`{c}`").alias(c) for c in rest])
    out = out.select(*[C(c) for c in table.df.columns])
    return table.derive(out)

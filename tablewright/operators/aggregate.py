"""Group by with count, sum, average, min and max.

One ``groupBy().agg()`` per node: Spark plans a partial (map-side) hash
aggregate, a shuffle on the group keys, and a final aggregate, so a hot key
is collapsed to one row per map task before it is shuffled.  Without group
columns it is a global aggregate that returns exactly one row, also on empty
input.  A union is where Spark's compiled loops end, so on a table in two parts (a full join with
hot keys) the part of many rows is aggregated in the stage that makes these rows, before the union.

Text columns keep the reference's dynamic typing: ``sum``/``average`` parse
numbers from text (a non-numeric cell is an ``AGGREGATE_NUMERIC_REQUIRED``
check), ``min``/``max`` pick the original cell with the smallest/largest
sort key (numbers by value, text in natural order) via ``min_by``/``max_by``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableError, require_columns, require_distinct
from ..functions import sniff as S
from ..table import C, CheckRule, OrderKey, Table, as_table, hidden_name

OPERATIONS = ("count", "sum", "average", "min", "max")
SHORT_NAMES = {"avg": "average"}


@dataclass(frozen=True)
class Rule:
    """One aggregate: what is computed of which column (``*`` for a count of rows), and its name."""
    operation: str
    column: str
    name: str

    @classmethod
    def read(cls, setting) -> "Rule":
        text = {k: str((setting or {}).get(k) or "").strip() for k in ("operation", "column", "as")}
        kind = SHORT_NAMES.get(text["operation"].lower(), text["operation"].lower())
        return cls(kind, "*" if kind == "count" else text["column"], text["as"])

    def check(self) -> None:
        lacks = [what for what, there in (("a known operation", self.operation in OPERATIONS), ("a column", self.column), ("a name", self.name)) if not there]
        if lacks:
            raise TableError("INVALID_AGGREGATE", f"An aggregate lacks {' and '.join(lacks)}.", operation=self.operation, column=self.column)


def _settings(table: Table, groups, aggregates) -> tuple[list[str], list[Rule]]:
    """Group columns and rules, checked against the table."""
    keys = [k for k in map(lambda g: str(g).strip(), groups) if k] if isinstance(groups, (list, tuple)) else []
    rules = list(map(Rule.read, aggregates or []))
    require_distinct(keys, "INVALID_AGGREGATE", "The group column")
    if not rules:
        raise TableError("INVALID_AGGREGATE", "There is nothing to aggregate.")
    for rule in rules:
        rule.check()
    require_columns(table.columns, keys + [r.column for r in rules if r.column != "*"])
    require_distinct(keys + [r.name for r in rules], "AGGREGATE_NAME_COLLISION", "The output column")
    return keys, rules


def _text_extreme(col, table_order_value, operation):
    """min/max of a text column by the reference's sort key."""
    parts = [p for p, is_flag in S.sort_key_fields(col, T.StringType()) if not is_flag]
    missing = col.isNull() | (col == "")
    if operation == "min":
        tie = [table_order_value] if table_order_value is not None else [col]
        key = F.when(~missing, F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts + tie)]))
        return F.min_by(col, key)
    key = F.when(~missing, F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts + [col])]))
    return F.max_by(col, key)


@dataclass(frozen=True)
class Step:
    """One column of a result in steps: its share of a part, the same of one row, and the shares put together."""
    share: Column
    of_row: Column
    merge: Callable[[Column], Column]


def _steps(fn: str, value: Column) -> list[Step]:
    """How an aggregate of typed values is made in steps; an average has two shares."""
    if fn == "count":
        return [Step(F.count(F.lit(1)), F.lit(1), F.sum)]
    if fn == "average":
        value = value.cast("double")
        return [*_steps("sum", value), Step(F.count(value), value.isNotNull().cast("long"), F.sum)]
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[fn]
    return [Step(fold(value), value, fold)]


def _in_steps(parts: tuple, names: list[str], made: dict[str, tuple[str, Column]]) -> DataFrame:
    """The aggregates ``made`` ({name: (function, value)}) of a table in two parts.  The first is aggregated by itself;
    rows of the second are put in the form of its result, and both are aggregated together."""
    many, few = parts
    keys = [C(n) for n in names]
    steps = {(name, i): (hidden_name("share"), step) for name, how in made.items() for i, step in enumerate(_steps(*how))}
    shares = many.groupBy(*keys).agg(*[step.share.alias(at) for at, step in steps.values()])
    rows = few.select(*keys, *[step.of_row.cast(shares.schema[at].dataType).alias(at) for at, step in steps.values()])
    merged = shares.unionByName(rows).groupBy(*keys).agg(*[step.merge(C(at)).alias(at) for at, step in steps.values()])

    def whole(name: str) -> Column:
        at = C(steps[name, 0][0])
        if made[name][0] != "average":
            return at
        n = C(steps[name, 1][0])
        return F.when(n > 0, at / n)
    return merged.select(*keys, *[whole(name).alias(name) for name in made])


def group_by(table, groups=None, aggregates=None) -> Table:
    table = as_table(table)
    names, rules = _settings(table, groups, aggregates)

    src = table
    ov = None
    if table.order and (names or any(r.operation == "min" for r in rules)):
        src, ov = table.order_value()
    aggs, checks = [], []
    made = {}  # aggregates that can be made in steps
    for rule in rules:
        op, name, alias = rule.operation, rule.column, rule.name
        if op == "count":
            aggs.append(F.count(F.lit(1)).alias(alias))
            made[alias] = op, F.lit(1)
            continue
        col, dtype = C(name), table.dtype(name)
        if op in ("sum", "average"):
            fn = F.sum if op == "sum" else F.avg
            if isinstance(dtype, S.NUMERIC_TYPES):
                value = col if op == "sum" and not isinstance(dtype, T.DecimalType) else col.cast("double")
                # Typed numbers need no check job (NaN/Infinity propagate, see README).
                aggs.append(fn(value).alias(alias))
                made[alias] = op, value
                continue
            if isinstance(dtype, T.StringType):
                num = S.number_of_text(S.js_trim(col))
                bad = col.isNotNull() & (col != "") & num.isNull()
            else:
                num = F.lit(None).cast("double")
                bad = col.isNotNull()
            aggs.append(fn(num).alias(alias))
            checks.append(CheckRule("AGGREGATE_NUMERIC_REQUIRED", f"Column {name} has a value that is no number, so there is no {op}.",
                                    bad, S.text_form(col, dtype), {"column": name, "operation": op}))
            continue
        # min / max
        if isinstance(dtype, T.StringType):
            aggs.append(_text_extreme(col, ov, op).alias(alias))
        elif isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
            text = F.to_json(col)
            aggs.append(_text_extreme(text, ov, op).alias(alias))
        else:
            aggs.append((F.min if op == "min" else F.max)(col).alias(alias))
            made[alias] = op, col

    order = ()
    if names:
        if ov is not None:
            first = hidden_name("first")
            aggs.append(F.min(ov).alias(first))
            made[first] = "min", ov
            order = (OrderKey(first),)
    if src.parts and len(made) == len(aggs):
        return Table(_in_steps(src.parts, names, made), order, src.checks, carried=src.carried)
    if checks:
        src = src.checked(checks)
    df = src.df.groupBy(*[C(n) for n in names]).agg(*aggs) if names else src.df.agg(*aggs)
    return Table(df, order, src.checks, carried=src.carried)

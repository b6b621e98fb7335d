"""``Table``: a DataFrame plus optional row order and deferred data checks.

DataFrames are unordered; pipelines are not (first row wins in dedup, groups
come out in first-seen order, limit keeps the first N).  Order is therefore
*opt-in metadata*: a list of sort keys over hidden columns (prefix
``__tw_``) that travel with the rows.  Operators extend it (sort prepends
keys, join concatenates, union prefixes the input number) and it is applied
once, at the sink or at a limit, so it never forces a sort on its own.

Checks (cast failures, non-numeric sums, misfit CSV rows) come in two forms.
A *carried* check is a filter in the rows' own plan that raises at the first bad row, so whatever
computes the rows checks them and no pass is added; it holds rows back from
being filtered away beneath it.  Where rows may be left uncomputed (a limit, a join), the
check is *loose* from there on: an aggregate over the DataFrame at the
node, run before results are written.  The same aggregate gives the error its value and count
once a carried check has failed, and is what :meth:`Table.validate` runs.
"""

from __future__ import annotations

import contextlib
import itertools
import uuid
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import TableError

HIDDEN = "__tw_"
_ids = itertools.count()


def hidden_name(tag: str) -> str:
    return f"{HIDDEN}{tag}{next(_ids)}"


def is_hidden(name: str) -> bool:
    return name.startswith(HIDDEN)


def C(name: str) -> Column:
    """Column by exact name (dots, spaces and non-ASCII are safe)."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class OrderKey:
    name: str
    desc: bool = False
    nulls_last: bool = False

    def column(self) -> Column:
        c = C(self.name)
        if self.desc:
            return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()


@dataclass(frozen=True)
class CheckRule:
    code: str
    message: str
    bad: Column
    value: Column | None = None
    details: dict = field(default_factory=dict)


@dataclass(frozen=True, eq=False)
class Check:
    """Rules evaluated together over ``df``: in one aggregate, or row by row where the table carries them."""
    df: DataFrame
    rules: tuple
    passed: list = field(default_factory=list)
    mark: str = field(default_factory=lambda: f"check-{uuid.uuid4().hex}")

    def carried(self) -> DataFrame:
        """``df`` with a filter that lets every row pass and raises at one that breaks a rule.

        A row id takes part, so the optimizer neither drops the filter nor moves others below it."""
        broken = F.coalesce(self.rules[0].bad, F.lit(False))
        for rule in self.rules[1:]:
            broken = broken | F.coalesce(rule.bad, F.lit(False))
        return self.df.filter(F.when(broken, F.raise_error(F.lit(self.mark)).cast("boolean"))
                              .otherwise(F.monotonically_increasing_id() >= 0))

    def once(self) -> None:
        if not self.passed:
            self.run()
            self.passed.append(True)

    def run(self) -> None:
        aggs = []
        for i, rule in enumerate(self.rules):
            aggs.append(F.count_if(rule.bad).alias(f"n{i}"))
            if rule.value is not None:
                aggs.append(F.first(F.when(rule.bad, rule.value.cast("string")), ignorenulls=True).alias(f"v{i}"))
        row = self.df.agg(*aggs).collect()[0]
        for i, rule in enumerate(self.rules):
            if row[f"n{i}"]:
                value = row[f"v{i}"] if rule.value is not None else None
                raise TableError(rule.code, rule.message, **rule.details, value=value, count=row[f"n{i}"])


class Table:
    """Immutable pair of a DataFrame and its row order."""

    def __init__(self, df: DataFrame, order=(), checks=(), meta: dict | None = None, carried=(), parts: tuple | None = None):
        self.df = df
        self.order = tuple(order)
        self.checks = tuple(checks)
        self.meta = dict(meta or {})
        #: checks that any action on all rows of ``df`` is sure to make
        self.carried = frozenset(carried)
        #: two DataFrames of which ``df`` is the union, first the one with far more rows than its inputs; None for most tables
        self.parts = parts

    # -- shape ---------------------------------------------------------------
    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not is_hidden(c)]

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if is_hidden(c)]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.df.schema.fields if not is_hidden(f.name)])

    def dtype(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    @property
    def ordered(self) -> bool:
        return bool(self.order)

    # -- derivation ------------------------------------------------------------
    def derive(self, df: DataFrame, order=None, checks=(), meta=None) -> "Table":
        """The same rows, or a selection of them made after all were computed."""
        return Table(df, self.order if order is None else order, self.checks + tuple(checks),
                     self.meta if meta is None else meta, self.carried)

    def checked(self, rules) -> "Table":
        """This table with a check that its rows carry."""
        check = Check(self.df, tuple(rules))
        return Table(check.carried(), self.order, (*self.checks, check), self.meta, self.carried | {check})

    def loosened(self) -> "Table":
        """This table, its checks no longer trusted to its rows: some of them may not be computed."""
        return Table(self.df, self.order, self.checks, self.meta)

    def to_df(self, ordered: bool = True) -> DataFrame:
        """Visible columns; sorted by the row order when there is one."""
        df = self.df
        if ordered and self.order:
            df = df.orderBy(*[k.column() for k in self.order])
        return df.select(*[C(c) for c in self.columns])

    def validate(self, carried: bool = True) -> "Table":
        """Run the checks as aggregates (one job each), without those the rows carry if so asked; raise the first failure.

        A check that has passed is not run again for tables derived later."""
        for check in dict.fromkeys(self.checks):
            if carried or check not in self.carried:
                with self.explained():
                    check.once()
        return self

    def explain(self, failure: Exception) -> Exception:
        """The error of the carried check that made an action fail; ``failure`` itself if none did."""
        check = next((c for c in self.checks if c.mark in str(failure)), None)
        if check is None:
            return failure
        try:
            check.run()
        except TableError as exc:
            return exc
        except PySparkException as exc:  # an earlier check fails too
            return self.explain(exc)
        return TableError(check.rules[0].code, check.rules[0].message, **check.rules[0].details)

    @contextlib.contextmanager
    def explained(self):
        """Around an action on the rows: a carried check that fails in it is raised as its own error."""
        try:
            yield
        except PySparkException as failure:
            known = self.explain(failure)
            if known is failure:
                raise
            raise known from failure

    # -- order helpers ---------------------------------------------------------------
    def materialize_order(self) -> "Table":
        """Replace the key list by one increasing rank.

        A range-partitioned sort followed by ``monotonically_increasing_id``
        gives ids that increase in sort order (partition index is the high
        part), without any single-partition step.
        """
        rank = hidden_name("rank")
        df = self.df.orderBy(*[k.column() for k in self.order]).withColumn(rank, F.monotonically_increasing_id())
        df = df.drop(*[k.name for k in self.order])
        return Table(df, (OrderKey(rank),), self.checks, self.meta, self.carried)

    def order_value(self) -> tuple["Table", Column | None]:
        """One ascending-comparable value equivalent to the order (for
        ``min``/``min_by``), materialising the order only when a descending
        text key makes that impossible."""
        if not self.order:
            return self, None
        if len(self.order) == 1 and not self.order[0].desc and not self.order[0].nulls_last \
                and isinstance(self.dtype(self.order[0].name), T.LongType):
            return self, C(self.order[0].name)  # one BIGINT: its minimum is a plain hash aggregate
        parts = []
        for key in self.order:
            c = C(key.name)
            dt = self.dtype(key.name)
            if key.desc:
                neg = _negate(c, dt)
                if neg is None:
                    return self.materialize_order().order_value()
                parts += [c.isNull() if key.nulls_last else c.isNotNull(), neg]
            else:
                parts += [c.isNull(), c] if key.nulls_last else [c]
        return self, F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def _negate(c: Column, dt: T.DataType) -> Column | None:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)):
        return -c
    if isinstance(dt, T.BooleanType):
        return ~c
    if isinstance(dt, T.DateType):
        return -F.unix_date(c)
    if isinstance(dt, T.TimestampType):
        return -F.unix_micros(c)
    if isinstance(dt, T.TimestampNTZType):
        return -F.unix_micros(c.cast("timestamp"))
    return None


def spread(df: DataFrame, key: Column, partitions: int) -> DataFrame:
    """Deal rows to ``partitions`` tasks by a stable per-row key.

    An explicit choice of the caller (a full shuffle): worth it only for one
    small file with costly per-row work.  No source calls it by itself."""
    tmp = hidden_name("spread")
    return df.withColumn(tmp, key).repartition(partitions, C(tmp)).drop(tmp)


def as_table(value) -> Table:
    if isinstance(value, Table):
        return value
    if isinstance(value, DataFrame):
        return Table(value)
    raise TypeError(f"expected a Table or DataFrame, got {type(value).__name__}")


def merge_checks(*tables: Table) -> tuple:
    """Checks of all tables, each once (a table joined to itself has one copy)."""
    return tuple(dict.fromkeys(c for t in tables for c in t.checks))

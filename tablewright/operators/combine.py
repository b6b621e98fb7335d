"""Join and union.

Join: equi-join on any number of key pairs.  Right-side columns are renamed
*before* joining (clashes become ``x_right``, ``x_right2`` ...), so the plan
never has ambiguous names, and keys of different families (text vs number)
never match, which is decided from the schema without running a join.
Strategy (broadcast hash vs shuffled sort-merge) is left to Catalyst and AQE:
broadcast happens only under ``spark.sql.autoBroadcastJoinThreshold`` on the
measured size, skewed partitions are split by AQE for inner/left/right joins.
Rows with null keys on a kept side can never match and would all land in one
shuffle partition; a second join key, a row hash that is set only there, deals
them out in the same pass.  A full join is the one kind whose skewed partitions are never split:
with ``hot_rows`` the rows of both sides are counted per bucket of a key hash, and buckets of that many rows or
more are joined apart, as an inner join of parts dealt out by a salt plus the rows of either side without a partner.

Union: by name (first-seen column order, missing columns null) or by
position, with types widened first so that ANSI mode never fails at run time.
"""

from __future__ import annotations

from functools import reduce
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableError, require_columns
from ..functions import sniff as S
from ..table import C, OrderKey, Table, as_table, hidden_name, merge_checks

JOIN_TYPES = ("inner", "left", "right", "full")
MAX_UNION_INPUTS = 6


def joined_right_names(left_columns, right_columns) -> dict[str, str]:
    """Name of each right column in the output: clashes get ``_right``, then
    ``_right2``, ``_right3`` ... against every name used so far."""
    used = set(left_columns)
    names = {}
    for col in right_columns:
        candidate = col
        if candidate in used:
            candidate = f"{col}_right"
        n = 2
        while candidate in used:
            candidate = f"{col}_right{n}"
            n += 1
        used.add(candidate)
        names[col] = candidate
    return names


def _key_pair(lcol: Column, ldt: T.DataType, rcol: Column, rdt: T.DataType) -> tuple[Column, Column] | None:
    """What is compared of one key pair, or None when the families can never match."""
    lf, rf = S.family(ldt), S.family(rdt)
    if lf != rf:
        return None
    if lf == "time":
        return lcol.cast("timestamp"), rcol.cast("timestamp")
    if isinstance(ldt, T.MapType) or isinstance(rdt, T.MapType):
        return F.to_json(lcol), F.to_json(rcol)
    return lcol, rcol


def _equal(compared: list[tuple]) -> Column:
    return reduce(lambda a, b: a & b, [a == b for a, b in compared])


#: Buckets of the key hash that hot keys are looked for in, rows that make one hot, and rows that a part of a hot bucket has at most if hot_rows is less.
HOT_BUCKETS, HOT_ROWS, CELL_ROWS = 1 << 16, 2_000_000, 20_000
#: Pairs of hot rows that a task is to make: a few seconds of work, so that tasks are many enough to end together.
TASK_PAIRS = 50_000_000
#: Types that a join compares as they are (it normalizes fractions first).
DEALT_TYPES = (T.IntegralType, T.StringType, T.BooleanType, T.DecimalType, T.TimestampType)


def _join_bucket(cols: list[Column], dtypes: list[tuple]) -> Column:
    """Bucket of a row's key, equal for keys that are equal across the two sides' types."""
    def plain(col: Column, pair: tuple) -> Column:
        if all(isinstance(t, S.NUMERIC_TYPES) for t in pair):
            return col.cast("double") + F.lit(0.0)  # one zero
        if S.family(pair[0]) == "time":
            return col.cast("timestamp")
        return col if pair[0] == pair[1] and S.family(pair[0]) in ("text", "boolean") else F.to_json(F.struct(col.alias("k")))
    return F.pmod(F.xxhash64(*[plain(c, p) for c, p in zip(cols, dtypes)]), F.lit(HOT_BUCKETS))


def _hot_buckets(sides: list[tuple], hot_rows: int) -> list[tuple]:
    """(bucket, left rows, right rows) of the buckets with ``hot_rows`` rows or more on a side: one count of at most HOT_BUCKETS rows per side."""
    counted = _union_all([df.filter(reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])).select(bucket.alias("b"), F.lit(i).alias("side"))
                          for i, (df, keys, bucket) in enumerate(sides)])
    most = counted.groupBy("b").agg(*[F.count_if(F.col("side") == i).alias(f"n{i}") for i in (0, 1)])
    return [tuple(r) for r in most.filter((F.col("n0") >= hot_rows) | (F.col("n1") >= hot_rows)).collect()]


def _parts(left_rows: int, right_rows: int, hot_rows: int) -> tuple[int, int]:
    """Parts that the two sides of a hot bucket are dealt into.  A part has as many rows as the smaller side, within hot_rows
    and CELL_ROWS, so copies come to little more than the larger side or to 2 / CELL_ROWS of the pairs."""
    size = max(hot_rows, min(left_rows, right_rows, CELL_ROWS))
    return max(1, -(-left_rows // size)), max(1, -(-right_rows // size))


def _cell_tasks(hot: list[tuple], hot_rows: int) -> int:
    """Tasks for the join of the cells: by its pairs, as a shuffle of few bytes would get few tasks.  With a few times the cells,
    most of those that have pairs get a task of their own, though a hash deals them out."""
    met = [(n0, n1) for _, n0, n1 in hot if n0 and n1]
    cells = sum(ln * rn for ln, rn in (_parts(n0, n1, hot_rows) for n0, n1 in met))
    return min(4 * cells, sum(n0 * n1 for n0, n1 in met) // TASK_PAIRS)


def _full_join(ldf: DataFrame, rdf: DataFrame, compared: list[tuple], keys: tuple, buckets: tuple, hot: list, hot_rows: int, rest) -> list[DataFrame]:
    """Full join whose hot buckets are joined apart, as two DataFrames: pairs of hot rows, and all else; ``rest`` joins the other rows.

    Hot rows meet in an inner join: each side of a bucket is dealt into parts, and a row is copied once per part of the other side, so
    every two rows meet in one cell.  Rows without a partner are found against the other side's distinct keys in the hot buckets."""
    lb, rb, cell, at, ln, rn = map(hidden_name, ("lb", "rb", "cell", "at", "ln", "rn"))
    same = _equal(compared)
    ldf, rdf = ldf.withColumn(lb, buckets[0]), rdf.withColumn(rb, buckets[1])
    # a row per bucket, not an expression: there may be thousands
    parts = ldf.sparkSession.createDataFrame([(b, *_parts(n0, n1, hot_rows)) for b, n0, n1 in hot], f"{at} long, {ln} long, {rn} long")
    chosen = lambda df, b, how: df.join(F.broadcast(parts if how == "inner" else parts.select(at)), C(b) == C(at), how)
    cold = rest(chosen(ldf, lb, "left_anti").drop(lb), chosen(rdf, rb, "left_anti").drop(rb))
    lrows, rrows = chosen(ldf, lb, "left_semi"), chosen(rdf, rb, "left_semi")

    def celled(df: DataFrame, b: str, mine: str, other: str, cell_of, name: str) -> DataFrame:
        own = F.pmod(F.monotonically_increasing_id(), C(mine))
        dealt = chosen(df, b, "inner").withColumn(name, own)
        copies = F.transform(F.sequence(F.lit(0).cast("long"), C(other) - 1), lambda o: cell_of(C(name), o))
        return dealt.withColumn(name, F.explode(copies)).drop(at, ln, rn)

    lcells = celled(ldf, lb, ln, rn, lambda own, o: own * C(rn) + o, cell)
    rcells = celled(rdf, rb, rn, ln, lambda own, o: o * C(rn) + own, f"{cell}r")
    tasks = _cell_tasks(hot, hot_rows)
    lks, rks = zip(*compared)
    alike = lrows.select(*lks).union(rrows.select(*rks)).schema
    if tasks > int(ldf.sparkSession.conf.get("spark.sql.shuffle.partitions")) and all(isinstance(f.dataType, DEALT_TYPES) for f in alike):
        # by all that the join compares, in its types: the join then needs no shuffle of its own
        lcells = lcells.repartition(tasks, *[k.cast(f.dataType) for k, f in zip(lks, alike)], C(cell), C(lb))
        rcells = rcells.repartition(tasks, *[k.cast(f.dataType) for k, f in zip(rks, alike)], C(f"{cell}r"), C(rb))
    # sizes are estimated without the copies, so Spark must not choose to broadcast them
    both = lcells.hint("merge").join(rcells, same & (C(cell) == C(f"{cell}r")) & (C(lb) == C(rb)), "inner").drop(cell, f"{cell}r")
    lkeys = lrows.select(*[k for k in keys[0]], C(lb)).distinct()
    rkeys = rrows.select(*[k for k in keys[1]], C(rb)).distinct()
    lonely = _pad(lrows.join(rkeys, same & (C(lb) == C(rb)), "left_anti"), rrows)
    ronely = _pad(rrows.join(lkeys, same & (C(lb) == C(rb)), "left_anti"), lrows)
    columns = [*ldf.drop(lb).columns, *rdf.drop(rb).columns]
    return [both, _union_all([d.select(*[C(c) for c in columns]) for d in (cold, lonely, ronely)])]


def join_tables(left, right, type: str = "inner", keys=None, hot_rows: int | None = None) -> Table:
    """Join of two tables.  ``hot_rows`` (full joins): one more pass over the keys finds buckets of keys with that
    many rows on a side, which are then joined apart."""
    left, right = as_table(left), as_table(right)
    how = str(type or "inner").lower()
    how = how if how in JOIN_TYPES else "inner"
    pairs = []
    for rule in keys or []:
        lk = str((rule or {}).get("left") or "").strip()
        rk = str((rule or {}).get("right") or "").strip()
        if lk or rk:
            pairs.append((lk, rk))
    if not pairs or any(not lk or not rk for lk, rk in pairs):
        raise TableError("INVALID_JOIN", "A join has one pair of key columns or more, and each pair is complete.")
    require_columns(left.columns, [lk for lk, _ in pairs])
    require_columns(right.columns, [rk for _, rk in pairs])

    names = joined_right_names(left.columns, right.columns)
    # Right side: visible columns renamed per J8, hidden columns made unique.
    hid_map = {h: hidden_name("r") for h in right.hidden}
    rdf = right.df.select(*[C(c).alias(names[c]) for c in right.columns],
                          *[C(h).alias(hid_map[h]) for h in right.hidden])
    right_order = tuple(OrderKey(hid_map[k.name], k.desc, k.nulls_last) for k in right.order)
    ldf = left.df
    ordered = bool(left.order or right.order)
    lmark = rmark = None
    if ordered:
        lmark, rmark = hidden_name("lm"), hidden_name("rm")
        ldf = ldf.withColumn(lmark, F.lit(True))
        rdf = rdf.withColumn(rmark, F.lit(True))

    compared = [_key_pair(C(lk), left.dtype(lk), C(names[rk]), right.dtype(rk)) for lk, rk in pairs]
    out_cols = left.columns + [names[c] for c in right.columns]

    if any(c is None for c in compared):
        made = [_never_matching(ldf, rdf, how)]
    elif how == "inner":
        made = [ldf.join(rdf, _equal(compared), how)]
    else:
        # Rows with a null key never match but are kept: a second key deals them out.  It is 0
        # where no key is null, and else a row hash, even on the left and odd on the right.
        lsalt, rsalt = hidden_name("ls"), hidden_name("rs")
        lkeys, rkeys = [C(lk) for lk, _ in pairs], [C(names[rk]) for _, rk in pairs]

        def kept(a: DataFrame, b: DataFrame) -> DataFrame:
            a, b = a.withColumn(lsalt, _null_salt(lkeys, a, 0)), b.withColumn(rsalt, _null_salt(rkeys, b, 1))
            return a.join(b, _equal(compared) & (C(lsalt) == C(rsalt)), how).drop(lsalt, rsalt)

        hot = {}
        if how == "full" and hot_rows:
            pair_types = [(left.dtype(lk), right.dtype(rk)) for lk, rk in pairs]
            buckets = _join_bucket(lkeys, pair_types), _join_bucket(rkeys, [(b, a) for a, b in pair_types])
            hot = _hot_buckets([(ldf, lkeys, buckets[0]), (rdf, rkeys, buckets[1])], hot_rows)
        made = _full_join(ldf, rdf, compared, (lkeys, rkeys), buckets, hot, hot_rows, kept) if hot else [kept(ldf, rdf)]

    hidden = [h for h in ldf.columns if h.startswith("__tw_")] + [h for h in rdf.columns if h.startswith("__tw_")]
    made = [d.select(*[C(c) for c in out_cols], *[C(h) for h in hidden]) for d in made]
    order = ()
    if ordered:
        side = hidden_name("side")
        if how == "right":
            place = F.lit(0)
            order = right_order + left.order
        else:
            # full: left-ordered rows first, then unmatched right rows
            place = F.when(C(lmark).isNull(), F.lit(1)).otherwise(F.lit(0))
            order = (OrderKey(side),) + left.order + right_order
        made = [d.withColumn(side, place).drop(lmark, rmark) for d in made]
    meta = {"column_map": dict(names)}
    return Table(_union_all(made), order, merge_checks(left, right), meta, parts=tuple(made) if len(made) == 2 else None)


def _null_salt(keys: list[Column], df: DataFrame, side: int) -> Column:
    hashable = [C(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    missing = reduce(lambda a, b: a | b, [k.isNull() for k in keys])
    spread = F.shiftleft(F.xxhash64(*hashable), 1).bitwiseOR(F.lit(2 + side))
    return F.when(missing, spread).otherwise(F.lit(0).cast("long"))


def _pad(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``df`` with null columns for everything only ``other`` has."""
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema.fields if f.name not in df.columns]
    return df.select("*", *extra)


def _union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def _never_matching(ldf: DataFrame, rdf: DataFrame, how: str) -> DataFrame:
    """Result of a join whose keys can never be equal (no join executed)."""
    parts = []
    if how in ("left", "full"):
        parts.append(_pad(ldf, rdf))
    if how in ("right", "full"):
        parts.append(_pad(rdf, ldf).select(*ldf.columns, *rdf.columns))
    if not parts:
        return _pad(ldf, rdf).limit(0)
    return _union_all([p.select(*ldf.columns, *rdf.columns) for p in parts])


# -- union -------------------------------------------------------------------------

def widen(types: list[T.DataType]) -> T.DataType:
    """Common type of one output column across union inputs."""
    types = [t for t in types if not isinstance(t, T.NullType)]
    if not types:
        return T.StringType()
    if all(t == types[0] for t in types):
        return types[0]
    if all(isinstance(t, S.NUMERIC_TYPES) for t in types):
        if any(isinstance(t, S.FRACTIONAL_TYPES) for t in types):
            return T.DoubleType()
        return T.LongType()
    if all(isinstance(t, S.TIME_TYPES) for t in types):
        if all(isinstance(t, (T.DateType, T.TimestampNTZType)) for t in types):
            return T.TimestampNTZType()
        return T.TimestampType()
    return T.StringType()


def conform(col: Column, dtype: T.DataType, target: T.DataType) -> Column:
    if dtype == target:
        return col
    if isinstance(target, T.StringType):
        return S.text_form(col, dtype)
    return col.cast(target)


def schema_mismatch(inputs: list[list[str]], mode: str, output: list[str]) -> dict:
    """Per input of a union, how its columns differ: by position from the output's names and the
    first input's width, by name from the output's and the first input's sets of columns."""
    first, whole = set(inputs[0]), set(output)

    def by_position(columns: list[str]) -> dict:
        pairs = zip_longest(columns, output[:len(columns)])
        return {"renamed": [{"from": a, "to": b} for a, b in pairs if a != b], "countMismatch": len(columns) != len(inputs[0])}

    def by_name(columns: list[str]) -> dict:
        return {"missing": sorted(whole.difference(columns), key=output.index), "extra": sorted(set(columns) - first, key=columns.index)}

    compare = by_position if mode == "position" else by_name
    found = [compare(columns) for columns in inputs]
    same = {"missing": [], "extra": [], "renamed": [], "countMismatch": False}
    return {"hasMismatch": any(any(f.values()) for f in found), "inputs": [{"index": i, **same, **f} for i, f in enumerate(found)]}


def union_tables(tables, mode: str = "name", max_inputs: int = MAX_UNION_INPUTS) -> Table:
    inputs = [as_table(t) for t in (tables or []) if t is not None]
    if len(inputs) < 2 or len(inputs) > max_inputs:
        raise TableError("INVALID_UNION", f"{len(inputs)} tables can't be united; 2 to {max_inputs} can.", inputCount=len(inputs))
    mode = "position" if mode == "position" else "name"
    if mode == "position":
        widths = [len(t.columns) for t in inputs]
        other = next((i for i, w in enumerate(widths) if w != widths[0]), None)
        if other is not None:
            raise TableError("UNION_SCHEMA_MISMATCH", f"Input {other} has {widths[other]} columns, the first has {widths[0]}.",
                             inputIndex=other, expected=widths[0], actual=widths[other])
        output = list(inputs[0].columns)
        sources = [dict(zip(output, t.columns)) for t in inputs]
    else:
        output = list(dict.fromkeys(c for t in inputs for c in t.columns))
        sources = [{c: c for c in t.columns} for t in inputs]
    targets = {}
    for name in output:
        targets[name] = widen([t.dtype(src[name]) for t, src in zip(inputs, sources) if name in src])

    ordered = any(t.order for t in inputs)
    idx_name = hidden_name("in") if ordered else None
    hid_maps = [{h: hidden_name("u") for h in t.hidden} for t in inputs]
    all_hidden = [(i, h, m[h], t.dtype(h)) for i, (t, m) in enumerate(zip(inputs, hid_maps)) for h in t.hidden]
    parts = []
    for i, (t, src) in enumerate(zip(inputs, sources)):
        cols = []
        for name in output:
            if name in src:
                cols.append(conform(C(src[name]), t.dtype(src[name]), targets[name]).alias(name))
            else:
                cols.append(F.lit(None).cast(targets[name]).alias(name))
        for j, h, new, dt in all_hidden:
            cols.append(C(h).alias(new) if j == i else F.lit(None).cast(dt).alias(new))
        if ordered:
            cols.append(F.lit(i).alias(idx_name))
        parts.append(t.df.select(*cols))
    df = reduce(lambda a, b: a.unionByName(b), parts)
    order = ()
    if ordered:
        order = (OrderKey(idx_name),) + tuple(
            OrderKey(m[k.name], k.desc, k.nulls_last) for t, m in zip(inputs, hid_maps) for k in t.order)
    meta = {"schema_mismatch": schema_mismatch([t.columns for t in inputs], mode, output)}
    return Table(df, order, merge_checks(*inputs), meta, frozenset().union(*[t.carried for t in inputs]))

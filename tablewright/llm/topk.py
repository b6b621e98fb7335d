"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are quantised to whole numbers, floor(scale * x).  The index cuts them into
blocks; in each block every dimension has posting lists, cut into segments of rows whose value
(the impact) lies in one step, ordered by impact.  A query's segments are processed by
descending impact, which is the query's component times the better edge of the step, so
after each round a posting not yet seen adds at most the impact of its dimension's next segment.
A row with u unseen postings then scores at most

    what its seen postings add at most + the sum of the u largest of those next impacts.

Processing stops only on proof: when all rows whose bound reaches the k-th best exact score so far
are few, as no other row can enter the result, or when all segments are done.  These possible
members are rescored exactly with their stored values.  Dimensions in which
the query is 0 add nothing and have no segments for it.

Blocks of candidates meet blocks of queries in one task each, so a task holds a bounded number of
values whatever the table's size; the k best of every block are merged per query.
Each candidate block is copied once per block of queries.

Vectors that are null or hold null, NaN or infinite components take no part, neither as query nor as candidate.
Vectors may differ in length: components that one of them lacks count as 0, and an empty vector scores 0
with all.  A query never finds its own row; other rows with its id are candidates.  Equal scores go
to the smaller id, null ids last.  Repeated rows all count.  Rows with a null id are
candidates and no queries.  Empty tables give no rows.  Scores of 2**53 or more can't
be bounded in doubles and raise an error.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256
TOP = 5
#: Values of a candidate block and of a query block.
CANDIDATE_VALUES, QUERY_VALUES = 1 << 20, 1 << 17
#: Steps that a dimension's values are cut into.
STEPS = 64
#: Shares of all postings after which the bounds are looked at.
ROUNDS = (0.05, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 1.0)
#: Of a block's rows, the share that may be left to rescore when processing stops.
FEW = 0.2
IDS = -1
INDEX = "block int, dim int, steps array<bigint>, ends array<bigint>, postings binary, cells binary, kind string, ids array<bigint>, rows array<bigint>"
HITS = "query_row bigint, query_id bigint, vec_id bigint, row bigint, score bigint"


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(row, id, v): usable vectors in whole numbers, with a row id that is staged once."""
    x = F.col(vector)
    usable = F.coalesce(F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))), F.lit(False))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return staged(df.filter(usable).select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), whole.alias("v")), "vectors")


def smallest(values: np.ndarray) -> np.ndarray:
    """Same values in the smallest integer type that holds them."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    return values.astype(np.promote_types(np.min_scalar_type(low), np.min_scalar_type(high)))


def matrix(rows: pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of integers, short ones filled with 0."""
    lengths = np.asarray(rows.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    dims = max(int(lengths.max(initial=0)), dims or 0)
    out = np.zeros((len(rows), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    return out


def index_block(key, table):
    """Index rows of one block: per dimension its posting segments and values, and one row with the ids."""
    values, block = matrix(table.column("v").combine_chunks()), key[0].as_py()
    out = []
    for j in range(values.shape[1]):
        column = values[:, j]
        width = max(1, -(-(int(column.max()) - int(column.min()) + 1) // STEPS))
        step = column // width
        order = np.argsort(-step, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(step[order]) != 0])
        cells = smallest(column)
        out.append((block, j, [width, *step[order][starts].tolist()], [*starts.tolist(), len(order)],
                    order.astype(np.uint16 if len(order) <= 1 << 16 else np.uint32).tobytes(), cells.tobytes(), cells.dtype.str, None, None))
    out.append((block, IDS, None, None, None, None, None, table.column("id").to_pylist(), table.column("row").to_pylist()))
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["block", "dim", "steps", "ends", "postings", "cells", "kind", "ids", "rows"]
    return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def build_index(vectors: DataFrame) -> DataFrame:
    """The index of (row, id, v): one row per block and dimension, staged."""
    rows, dims = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-rows * max(dims, 1) // CANDIDATE_VALUES))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return staged(dealt.groupBy("block").applyInArrow(index_block, INDEX), "impact-index")


class Block:
    """One block of the index, ready to be searched."""

    def __init__(self, table: pa.Table):
        rows = sorted(table.to_pylist(), key=lambda r: r["dim"])
        self.ids, self.rows = rows[0]["ids"], np.array(rows[0]["rows"], np.int64)
        self.size = len(self.rows)
        # ids with nulls last; ties in score are broken by this place
        order = sorted(range(self.size), key=lambda i: (self.ids[i] is None, self.ids[i] or 0, int(self.rows[i])))
        self.place = np.empty(self.size, np.int64)
        self.place[order] = np.arange(self.size)
        dims = rows[1:]
        self.values = np.stack([np.frombuffer(r["cells"], r["kind"]) for r in dims], axis=1).astype(np.int64) if dims else np.zeros((self.size, 0), np.int64)
        kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.postings = [np.frombuffer(r["postings"], kind).astype(np.int32) for r in dims]
        # segments of all dimensions side by side: dimension, edges of its values, range of postings
        self.dim = np.array([j for j, r in enumerate(dims) for _ in r["steps"][1:]], np.int64)
        width = np.array([r["steps"][0] for r in dims for _ in r["steps"][1:]], np.int64)
        step = np.array([s for r in dims for s in r["steps"][1:]], np.int64)
        self.low, self.high = step * width, step * width + width - 1
        self.start = np.array([e for r in dims for e in r["ends"][:-1]], np.int64)
        self.end = np.array([e for r in dims for e in r["ends"][1:]], np.int64)
        self.reach = np.abs(self.values).max(axis=0, initial=0).astype(np.float64)

    def exact(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.values[at] @ query

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> tuple:
        order = np.lexsort((self.place[at], -scores))[:k]
        return at[order], scores[order]

    def search(self, query: np.ndarray, own: int, k: int) -> tuple:
        """Local rows and scores of the k best rows, the row ``own`` left out."""
        dims = self.values.shape[1]
        query = np.resize(np.r_[query[:dims], np.zeros(max(0, dims - len(query)), np.int64)], dims)
        if float(np.abs(query).astype(np.float64) @ self.reach) >= 2.0 ** 53:
            raise OverflowError("scores of 2**53 or more")
        others = np.flatnonzero(self.rows != own)
        if len(others) <= k:
            return self.best(others, self.exact(query, others), k)
        factor = query[self.dim]
        used = np.flatnonzero(factor != 0)
        impact = np.maximum(factor * self.high, factor * self.low)[used]
        order = np.argsort(-impact, kind="stable")
        used, impact = used[order], impact[order]
        seen_postings = np.cumsum(self.end[used] - self.start[used])
        live = int(np.count_nonzero(query))
        bound, seen = np.zeros(self.size), np.zeros(self.size, np.int64)
        at, least, few = 0, -(1 << 60), max(4 * k, int(FEW * self.size))
        possible = others
        for share in ROUNDS if live else ():
            stop = int(np.searchsorted(seen_postings, share * seen_postings[-1], "left")) + 1
            part, at = slice(at, min(stop, len(used))), min(stop, len(used))
            segments = used[part]
            if len(segments):
                rows = np.concatenate([self.postings[d][a:b] for d, a, b in zip(self.dim[segments], self.start[segments], self.end[segments])])
                adds = np.repeat(impact[part].astype(np.float64), self.end[segments] - self.start[segments])
                bound += np.bincount(rows, adds, self.size)
                seen += np.bincount(rows, minlength=self.size)
            # the next impact of each dimension that has segments left; a row's unseen ones add no more than the largest of them
            ahead = np.unique(self.dim[used[at:]], return_index=True)[1]
            rest = np.r_[0.0, np.cumsum(np.sort(impact[at:][ahead].astype(np.float64))[::-1])]
            most = bound + rest[live - seen]
            # the rows that lead by now raise the k-th best exact score
            lead = others[np.argpartition(-most[others], min(8 * k, len(others) - 1))[:8 * k]]
            least = max(least, int(np.partition(self.exact(query, lead), len(lead) - k)[len(lead) - k]))
            possible = others[most[others] >= least]
            if len(possible) <= few:
                break
        return self.best(possible, self.exact(query, possible), k)


def search_block(k: int):
    def run(key, block, queries):
        out = []
        if len(block) and len(queries):
            b = Block(block)
            vectors = queries.column("v").combine_chunks()
            for i, (row, qid) in enumerate(zip(queries.column("row").to_pylist(), queries.column("id").to_pylist())):
                found, scores = b.search(vectors[i].values.to_numpy(zero_copy_only=False).astype(np.int64), row, k)
                out += [(row, qid, b.ids[f], int(b.rows[f]), int(s)) for f, s in zip(found.tolist(), scores.tolist())]
        return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], ["query_row", "query_id", "vec_id", "row", "score"])
    return run


def search(queries: DataFrame, index: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of the index for every row (row, id, v) of ``queries``."""
    count, dims = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    groups = max(1, -(-count * max(dims, 1) // QUERY_VALUES))
    blocks = index.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0] + 1
    if not blocks:
        return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("grp", each(groups))
    right = queries.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).withColumn("block", each(blocks))
    met = left.groupBy("block", "grp").cogroup(right.groupBy("block", "grp")).applyInArrow(search_block(k), HITS)
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("row")]
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(df: DataFrame, is_query: Column, k: int = TOP, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Top k of all other rows for the rows of ``df`` for which ``is_query`` (of the column ``id``) holds."""
    vectors = quantised(df, key, vector)
    return search(vectors.filter(is_query), build_index(vectors), k)

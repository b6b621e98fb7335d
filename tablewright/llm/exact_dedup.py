"""Exact duplicates by a tree merge of digest runs (DataFrame operations only).

Every row gets a digest of its whole text and belongs to one of R runs (by a
hash of its row id).  A run is reduced to one entry per digest: identifier to keep
and number of rows.  Then runs are merged in rounds, FAN runs into one.  In round k a merged run is
cut into FAN ** k ranges of digests, so the partitions of FAN runs exchange ranges among themselves and each
ends up with one range of the merged run: as many partitions as before, of the same size.  There
the entries of all FAN runs are merged in sorted order, and of equal digests, which are
neighbours by then, the best identifier and the sum of rows stay.  The last
round leaves one entry per digest.  The way back down hands the winner to every
entry of the round below and at last to the rows, so that no join meets more
than FAN entries per key above the rows, and the rows of one large group of
copies stay spread over all R runs.

An entry is (SHA-256, byte length, 64-bit hash) of the text; all three must
agree, which verifies that merged entries are of equal texts.

Null and empty texts are equal (both count as empty).  Null ids lose against
any other id.  Of repeated rows (same id and text) one stays.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import full_text, id_key, staged

#: Runs merged into one in a round.
FAN = 4
#: Rows that one run holds on average before the first round.
ROWS_PER_RUN = 20_000
DIGEST = ["sha", "n_bytes", "check"]


def _digest_columns(text: str):
    whole = full_text(text)
    return [F.sha2(whole, 256).alias("sha"), F.octet_length(whole).cast("long").alias("n_bytes"),
            F.xxhash64(whole).alias("check")]


def rounds_for(rows: int, rows_per_run: int = ROWS_PER_RUN, fan: int = FAN) -> int:
    """Rounds so that a run holds about ``rows_per_run`` rows; grows with the input's logarithm."""
    n = 1
    while fan ** n * rows_per_run < rows:
        n += 1
    return n


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document: id, digest, and a row id that is fixed once staged."""
    return docs.select(F.col(id_col).alias("id"), *_digest_columns(text), F.monotonically_increasing_id().alias("row"))


def merged(level: DataFrame, k: int, parts: int, fan: int = FAN, keep: str = "largest") -> DataFrame:
    """Round ``k``: the entries (run, digest, best, n) of FAN runs in one sorted run each, equal digests reduced to one."""
    place = F.conv(F.substring("sha", 1, 8), 16, 10).cast("double") / 2.0 ** 32
    up = level.withColumn("run", F.floor(F.col("run") / fan)).withColumn("range", F.floor(place * fan ** k))
    best = F.col("best").desc() if keep == "largest" else F.col("best").asc()
    # the exchange and the sort serve the windows below as well
    run = up.repartition(parts, "run", "range").sortWithinPartitions("run", "range", *DIGEST, best)
    same = Window.partitionBy("run", "range", *DIGEST)
    sums = run.withColumn("first", F.row_number().over(same.orderBy(best))).withColumn("n", F.sum("n").over(same))
    return sums.filter("first = 1")


def merge_runs(rows: DataFrame, keep: str = "largest", rows_per_run: int = ROWS_PER_RUN, fan: int = FAN):
    """(rows with their run, tables of the rounds from single runs up to one).

    ``rows`` must be staged (row ids fixed).  ``keep`` is ``largest`` or
    ``smallest`` identifier.
    """
    rounds = rounds_for(rows.count(), rows_per_run, fan)
    runs = fan ** rounds
    dealt = rows.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(runs)))
    # nulls sort below all other values in a struct: a null id wins only for lack of others
    rank = F.struct("id", "row") if keep == "largest" else F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    best = F.max if keep == "largest" else F.min
    level = staged(dealt.groupBy("run", *DIGEST).agg(best(rank).alias("best"), F.count(F.lit(1)).alias("n")), "run0")
    levels = [level]
    for k in range(1, rounds + 1):
        level = staged(merged(level, k, runs, fan, keep).select("run", *DIGEST, "best", "n"), f"run{k}")
        levels.append(level)
    return dealt, levels


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "largest",
                 rows_per_run: int = ROWS_PER_RUN, fan: int = FAN) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = staged(digest_rows(docs, id_col, text), "digests")
    dealt, levels = merge_runs(rows, keep, rows_per_run, fan)
    top = levels[-1]
    for k in range(len(levels) - 2, -1, -1):
        over = top.select(F.col("run").alias("over"), *DIGEST, F.col("best").alias("top_best"), F.col("n").alias("top_n"))
        below = levels[k].withColumn("over", F.floor(F.col("run") / fan))
        top = below.join(over, ["over", *DIGEST]).select("run", *DIGEST, F.col("top_best").alias("best"), F.col("top_n").alias("n"))
    out = dealt.join(top, ["run", *DIGEST])
    return out.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
                      (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "largest",
                    rows_per_run: int = ROWS_PER_RUN, fan: int = FAN) -> DataFrame:
    """The rows that stay, with all columns of ``docs``.

    Rows meet the winners on (id, digest): copies have different ids, so a
    large group is not gathered anywhere.
    """
    rows = staged(digest_rows(docs, id_col, text), "digests")
    winners = merge_runs(rows, keep, rows_per_run, fan)[1][-1].select(F.col("best.id").alias("id"), *DIGEST)
    right = winners.select(*id_key("id", "__id"), *DIGEST)
    left = docs.select(F.struct("*").alias("__row"), *id_key(id_col, "__id"), *_digest_columns(text))
    key = ["__id", "__id_null", *DIGEST]
    # only rows repeated whole (same id and text) still meet in the window
    one = Window.partitionBy(*key).orderBy(F.xxhash64("__row"))
    return left.join(right, key).withColumn("__n", F.row_number().over(one)).filter("__n = 1").select("__row.*")

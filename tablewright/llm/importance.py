"""Importance resampling towards a target distribution.

Features are runs of consecutive words, hashed into ``BUCKETS``.  The log ratio of
a bucket's share in the target texts to its share in the documents (both smoothed by
one) is its gain, a whole number of thousandths; a document's weight is the floored
mean of its features' gains.  Adding Gumbel noise, which a hash of the id fixes, to
the weights and taking the largest sums draws documents without replacement in
proportion to exp(weight).

Array-scored weights: the gains are one array of ``BUCKETS`` longs, whatever the
input; tasks look a text's buckets up in it.  Texts are read twice (counts, then
weights), words never leave their task: what is shuffled are counts per bucket.

Quantile-sketch bracketing: how many rows are drawn is known from a count.  A sketch
of the scores gives two scores around the cutoff's place; exact counts of the rows
above and inside the bracket show whether the cutoff lies in it, and as long as
it does not, the bracket is widened on that side.  Only rows inside the bracket are sorted
(range partitions) to find the row at the cutoff.  Drawn rows are then ranked in
range partitions, with one offset per partition.

Null and empty texts have no features: weight 0, not drawn.  Documents with fewer than ``MIN_WORDS``
words get a score and are not drawn.  Equal scores go to the smaller id, null ids last;
rows that are equal in both are drawn in the order of a row id fixed when the scores are
staged.  Repeated rows all count.  Long texts count whole.  Empty documents give
no rows; without target texts all gains follow from the smoothing alone.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 10_000
#: Longest run of words that is a feature.
RUNS = 1
MIN_WORDS = 20
#: Of 100 documents that may be drawn, how many are.
PERCENT = 10
SEED = 2024
#: ASCII bytes: A-Z to a-z, digits and a-z stay, all others separate words.  Bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Rank error of the sketch, as one part in so many.
ACCURACY = 2_000


def words_of(text: str | None) -> list:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def buckets_of(words: list, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every run of 1 to ``runs`` words, repeats included."""
    grams = [words] + [[b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] for n in range(2, runs + 1)]
    return np.fromiter((zlib.crc32(g) for part in grams for g in part), np.int64) % buckets


def bucket_counts(docs: DataFrame, text: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; each task counts its rows first."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += np.bincount(buckets_of(words_of(t), runs, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])
    return docs.select(text).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def fit_gains(docs: DataFrame, target: DataFrame, text: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket; the driver gets at most ``buckets`` rows."""
    both = bucket_counts(docs, text, runs, buckets).withColumn("of", F.lit(0)) \
        .union(bucket_counts(target, text, runs, buckets).withColumn("of", F.lit(1)))
    counts = np.zeros((2, buckets))
    for r in both.groupBy("bucket", "of").agg(F.sum("n").alias("n")).collect():
        counts[r["of"], r["bucket"]] = r["n"]
    (s, t), (all_s, all_t) = counts, counts.sum(axis=1)
    ratio = ((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(gains: np.ndarray, text: str = "text", runs: int = RUNS) -> Column:
    """Struct of n_words, n_features and weight."""
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            words = words_of(t)
            found = buckets_of(words, runs, len(gains))
            rows.append((len(words), len(found), int(gains[found].sum()) // len(found) if len(found) else 0))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["n_words", "n_features", "weight"])
    return F.arrow_udf(run, "struct<n_words:bigint,n_features:bigint,weight:bigint>")(F.col(text))


def noise(key: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id alone (a null id counts as the text ``null``)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def place(key: str = "doc_id") -> Column:
    """Order of drawing: smaller places first."""
    return F.struct((-F.col("score")).alias("s"), F.col(key).isNull().alias("z"), F.col(key).alias("k"), F.col("row").alias("r"))


def bracket(rows: DataFrame, take: int, total: int) -> tuple:
    """(low, high, rows above high): scores with the ``take``-th largest of ``total`` between them, by exact counts."""
    share, slack = 1 - take / total, 2 / ACCURACY
    low, high = rows.agg(F.percentile_approx("score", [max(0.0, share - slack), min(1.0, share + slack)], F.lit(ACCURACY))).first()[0]
    while True:
        above, inside = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < take <= above + inside:
            return low, high, above
        width = max(high - low, 1)
        if above >= take:
            low, high = high, high + 2 * width
        else:
            low, high = low - 2 * width, low


def cutoff(rows: DataFrame, take: int, total: int, key: str = "doc_id") -> tuple:
    """Score, id and row of the ``take``-th row in drawing order; only the bracket's rows are sorted."""
    low, high, above = bracket(rows, take, total)
    inside = rows.filter(F.col("score").between(low, high)).select(key, "score", "row")
    ranked = rank_rows(inside, take - above, key)
    return ranked.filter(F.col("rank") == take - above).select("score", key, "row").first()


def rank_rows(rows: DataFrame, expected: int, key: str = "doc_id") -> DataFrame:
    """Adds ``rank``, 1, 2, 3... in drawing order: ranges of that order, each ranked alone, plus the rows of the ranges before."""
    ranges = rows.repartitionByRange(bucket_count(expected), place(key)).withColumn("__part", F.spark_partition_id())
    fixed = staged(ranges, "ranked")
    sums = fixed.groupBy(F.col("__part").alias("__p")).count()
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    local = fixed.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(place(key))))
    joined = local.join(base, F.col("__part") == F.col("__p"))
    return joined.withColumn("rank", (F.col("__base") + F.col("__n")).cast("long")).drop("__part", "__p", "__base", "__n")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """key, n_features, weight, score, rank (null: not drawn) of every document."""
    gains = fit_gains(docs, target, text)
    weighed = docs.select(F.col(key), weigh(gains, text).alias("w"))
    scored = staged(weighed.select(F.col(key), "w.*", (F.col("w.weight") + noise(key)).cast("long").alias("score"),
                                   F.monotonically_increasing_id().alias("row")), "scored")
    able = F.col("n_words") >= MIN_WORDS
    total = scored.filter(able).count()
    take = percent * total // 100
    columns = [key, "n_features", "weight", "score"]
    if not take:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = cutoff(scored.filter(able).select(key, "score", "row"), take, total, key)
    end = F.struct(F.lit(-last["score"]).cast("long").alias("s"), F.lit(last[key] is None).alias("z"),
                   F.lit(last[key]).cast(docs.schema[key].dataType).alias("k"), F.lit(last["row"]).cast("long").alias("r"))
    drawn = able & (place(key) <= end)
    rest = scored.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    return rank_rows(scored.filter(drawn).select(*columns, "row"), take, key).select(*columns, "rank").unionByName(rest)

"""Mixing sources to target weights along a time-varying curriculum (DataFrame operations only).

Sizes are words.  Sources, ordered by code point with null last, get the
weights 3, 1, 2 in turn; together they share ``volume`` times all words.  A
source is read ``max_passes`` times at most, so its target stops there and the
excess is shared again by weight.  That is a water level: sources ordered by
capacity per weight fill up one after the other, the rest take level x weight
(one closed form over the table of sources, no loop).

A source's documents form a stream in the order of a hash of their ids, read
again from the start in a second pass.  The stream is cut at the target, inside
a document if need be, so the words taken differ from the target by less
than one.

The curriculum gives each weight class a schedule: rates at knots over the time
0 to 1, linear between them.  The integral of the schedule, scaled to the
target, is the cumulative demand for the source's words; inverting it at the
middle of a document's words gives the time at which the document is due, its
position.  ``curriculum`` sorts all taken documents by position.

Null text has size 0.  Documents of size 0 are never taken.  Null sources are
one source of their own, null ids hash as ``null``; equal ids are ordered by
size and text hash, so reruns agree; rows repeated whole are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, hex_number, running_total, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
VOLUME = 1.5
MAX_PASSES = 2
#: Rates at the times of KNOTS for each weight class: early, even and late sources.
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.25, 0.75, 2.0))


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def invert_schedule(share: Column, rates: tuple, knots: tuple = KNOTS) -> Column:
    """Time by which ``share`` (0 to 1) of the schedule's integral has passed."""
    areas = [(b - a) * (r + s) / 2 for a, b, r, s in zip(knots, knots[1:], rates, rates[1:])]
    total, done, out = sum(areas), 0.0, None
    for a, b, r, s, area in zip(knots, knots[1:], rates, rates[1:], areas):
        if area <= 0:
            continue
        rest = F.greatest(share - F.lit(done / total), F.lit(0.0)) * F.lit(total)
        # r x + (s - r) x^2 / (2 (b - a)) = rest, in the form without cancellation
        root = F.sqrt(F.greatest(F.lit(r * r) + rest * F.lit(2 * (s - r) / (b - a)), F.lit(0.0)))
        x = F.when(rest > 0, 2 * rest / (F.lit(r) + root)).otherwise(F.lit(0.0))
        here = F.least(F.lit(a) + x, F.lit(b))
        done += area
        inside = share < F.lit(done / total)
        out = F.when(inside, here) if out is None else out.when(inside, here)
    return out.otherwise(F.lit(knots[-1]))


def source_targets(sized: DataFrame, source: str, weights=WEIGHTS, volume: float = VOLUME,
                   max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: source_rank, class, source_size, target."""
    by = sized.groupBy(F.col(source).alias("__source")).agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("__source").asc_nulls_last())
    cls = F.pmod(F.col("source_rank") - 1, F.lit(len(weights)))
    everything = Window.partitionBy(F.lit(0))
    t = by.withColumn("source_rank", F.row_number().over(ordered)).withColumn("class", cls)
    t = t.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("class") + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * max_passes)
    filling = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "source_rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("left", F.sum("source_size").over(everything) * volume - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    t = t.withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("full", F.col("cap") * F.col("left_w") <= F.col("w") * F.col("left"))
    # the first source that is not full sees the level; it is the largest among them
    level = F.max(F.when(~F.col("full"), F.col("left") / F.col("left_w"))).over(everything)
    return t.select("__source", "source_rank", "class", "source_size",
                    F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * level).alias("target"))


def plan_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
             volume: float = VOLUME, max_passes: int = MAX_PASSES, schedules=SCHEDULES, knots=KNOTS,
             carry: bool = False) -> DataFrame:
    """One row per document: key, size, source_size, target, taken, and passes.

    ``passes`` is an array of (pass, taken, position), one for each pass that
    takes words of the document.  With ``carry`` the whole input row comes
    along as the struct ``row``; else only a narrow staged table is shuffled.
    """
    if len(schedules) != len(weights):
        raise ValueError("one schedule per weight class is needed")
    sized = docs.select(F.col(key).alias("__key"), F.col(source).alias("__src"), word_count(text).alias("size"),
                        hex_number(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")))).alias("__place"),
                        F.xxhash64(F.col(text)).alias("__tie"), *([F.struct("*").alias("row")] if carry else []))
    if not carry:
        sized = staged(sized, "mix-sizes")
    targets = staged(source_targets(sized, "__src", weights, volume, max_passes), "mix-targets")
    with_target = sized.join(targets, F.col("__src").eqNullSafe(F.col("__source"))).drop("__src", "__source")
    streamed = running_total(with_target, "source_rank", "__place", ["__key", "size", "__tie"], "size", "__from",
                             bucket_count(sized.count()))
    goal = F.round("target").cast("long")

    def one_pass(p: int) -> Column:
        start = F.col("__from") + F.col("source_size") * p
        words = F.greatest(F.least(goal - start, F.col("size")), F.lit(0)).cast("long")
        share = F.when(F.col("target") > 0, (start + words / 2) / F.col("target")).otherwise(F.lit(0.0))
        time = None
        for c, rates in enumerate(schedules):
            t = invert_schedule(share, rates, knots)
            time = F.when(F.col("class") == c, t) if time is None else time.when(F.col("class") == c, t)
        return F.struct(F.lit(p).alias("pass"), words.alias("taken"), time.alias("position"))

    passes = F.filter(F.array(*[one_pass(p) for p in range(max_passes)]), lambda x: x["taken"] > 0)
    out = streamed.withColumn("passes", passes)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x["taken"])
    return out.select(*(["row"] if carry else []), F.col("__key").alias(key), "size", "source_size", "target",
                      taken.alias("taken"), "passes")


def curriculum(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the input's rows, one per pass that takes a document, sorted by position over all partitions.

    A document whose words the target cuts is given whole, so texts are never cut.
    """
    key = how.get("key", "doc_id")
    due = plan_mix(docs, carry=True, **how).select("row", F.col(key).alias("__key"), F.explode("passes").alias("__p"))
    placed = due.select("row", "__key", F.col("__p.position").alias("__at"), F.col("__p.pass").alias("__pass"))
    ranges = bucket_count(2 * docs.count())  # ranges can't be split later, so their number grows with the input
    spread = placed.repartitionByRange(ranges, F.col("__at"), F.col("__key"))
    return spread.sortWithinPartitions("__at", "__key", "__pass").select("row.*")

"""Near-duplicate documents by DartMinHash signatures and banded joins.

Elements of a text are its 5-word shingles (a text of fewer words is one
shingle), the weight of an element is how often it occurs, and the similarity
of two texts is the weighted Jaccard similarity, sum of smaller weights / sum of
larger weights.  Texts are near duplicates when it is at least 0.8; classes are
the connected components of that relation.

Signature.  The plane over an element, weight x time, is cut into strips of
weight [0, 1), [1, 2), [2, 4), [4, 8), ...  In each strip hashed darts land one
after the other at exponential distances in time (rate: the strip's width), each
with a weight inside the strip and a coordinate.  A dart hits a text when its
weight is below the element's.  Per coordinate the earliest hit is the
signature's value.  Two texts agree on a coordinate with a probability equal to
their similarity.  Darts are thrown until the time by which a text expects
``k (ln k + 3)`` hits; a text with an empty coordinate throws on for twice as
long.  The work is the number of elements plus darts, not their product.

Join.  Signatures are cut into BANDS bands of ROWS values; texts with an equal
band meet in a bucket.  A pair of similarity s misses all buckets with
probability (1 - s^7)^42: 5e-5 at 0.8.  No bucket is expanded into its pairs: first each member meets
the bucket's first member (the pivot), and the exact similarity of the two whole
texts decides.  Buckets whose members then lie in more than one component go on:
small ones (at most SMALL members) with all their pairs of different components, larger ones with the next
pivot, PIVOTS times; what is still split after that is compared in full, each
member outside of the bucket's largest component with all members of others.
So every pair that shares a bucket ends up in one component or was compared.

Copies (equal words in equal order) are one node; they are never paired.
Texts without words (null, empty, white space) are in no relation: each is a
class of its own.  Repeated rows are copies of each other.  Null ids sort last.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key, staged
from .worker import SPACE, Memo, each, keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
#: The threshold as a fraction, for exact comparisons of weights.
PART, OF = 4, 5
THRESHOLD = PART / OF
ROWS, BANDS = 7, 42
#: Members up to which a bucket is compared in full at once.
SMALL = 16
#: Further pivots of larger buckets.
PIVOTS = 3
#: Hash bins of a text's profile.
BINS = 256
#: Members of a block that is compared at once.
SIDE = 512
#: Elements that are signed together (bounds the memory of a worker).
BLOCK = 200_000
#: Bytes of a worker's memo of word hashes.
WORDS = 40 << 20
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list:
    return (text or "").encode("utf-8", "surrogatepass").split()


def weighted_shingles(text: str | None, size: int = SHINGLE) -> tuple:
    """(sorted shingle hashes, their counts) of a whole text."""
    return shingles_of(words_of(text), size)


def shingles_of(parts: list, size: int = SHINGLE) -> tuple:
    memo = keep("word_hash", lambda: Memo(xxhash.xxh3_64_intdigest, WORDS))
    words = np.fromiter(map(memo.__getitem__, parts), np.uint64, len(parts))
    if not len(words):
        return words, np.zeros(0, np.int64)
    span = max(1, len(words) - size + 1)
    out = np.full(span, np.uint64(min(size, len(words))))
    for k in range(min(size, len(words))):
        out = mix(out ^ words[k:k + span])
    return np.unique(out, return_counts=True)


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two results of ``weighted_shingles``; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    low = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return low / (int(a[1].sum()) + int(b[1].sum()) - low)


def signatures(sets: list, k: int, most: list | None = None) -> np.ndarray:
    """One row of ``k`` dart hashes per weighted set (elements, weights); sets must not be empty."""
    n = len(sets)
    best = np.full(n * k, np.inf)
    value = np.zeros(n * k, np.uint64)
    sizes = [len(e) for e, _ in sets]
    element = np.concatenate([e for e, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(float)
    owner = np.repeat(np.arange(n), sizes)
    total = np.bincount(owner, weight, n)
    until = k * (math.log(k) + 3) / total if most is None else np.asarray(most)
    strip, low = 0, 0.0
    while len(element):
        width = 1.0 if strip == 0 else low
        seed, w, of, time = mix(element ^ mix(np.full(1, strip, np.uint64))), weight, owner, np.zeros(len(element))
        # whole weights of at least the strip's top are hit by all its darts
        dart, filled = 0, bool(len(w)) and w.min() >= low + width
        while len(seed):
            h = mix(seed + np.full(1, dart, np.uint64) * _C)
            # 32 bits for the distance, 16 for the weight, 16 for the coordinate
            step = np.log(((h >> np.uint64(32)) + 0.5) / 2.0 ** 32)
            time = time - (step if width == 1.0 else step / width)
            on = np.flatnonzero(time < until[of])
            seed, of, time, h = seed[on], of[on], time[on], h[on]
            w = w if filled else w[on]
            dart += 1
            at, when, whose = h, time, of
            if not filled:
                hit = np.flatnonzero(low + width * (((h >> np.uint64(16)) & np.uint64(0xFFFF)) + 0.5) / 65536.0 < w)
                at, when, whose = h[hit], time[hit], of[hit]
            slot = whose * k + (at & np.uint64(0xFFFF)).astype(np.int64) % k
            np.minimum.at(best, slot, when)
            first = np.flatnonzero(best[slot] == when)
            value[slot[first]] = at[first]
        low += width
        strip += 1
        over = weight > low
        element, weight, owner = element[over], weight[over], owner[over]
    value = value.reshape(n, k)
    short = np.nonzero(np.isinf(best.reshape(n, k)).any(axis=1))[0]
    if len(short):
        value[short] = signatures([sets[i] for i in short], k, [2 * until[i] for i in short])
    return value


def bands(sets: list, rows: int = ROWS, count: int = BANDS) -> np.ndarray:
    """One row of ``count`` band hashes (signed 64-bit) per weighted set."""
    s = signatures(sets, rows * count).reshape(len(sets), count, rows)
    out = np.broadcast_to(mix(np.arange(count, dtype=np.uint64)), (len(sets), count))
    for r in range(rows):
        out = mix(out ^ s[:, :, r])
    return out.view(np.int64)


def _signed(texts: pa.Array) -> pa.Array:
    """Per text, the digest of its words in order and its band hashes; null and empty for texts without words."""
    digests, parts, group, load = [], [], [], 0
    for text in each(texts):
        words = words_of(text)
        digests.append(hashlib.sha256(b" ".join(words)).digest() if words else None)
        if words:
            group.append(shingles_of(words))
            load += len(group[-1][0])
        if load >= BLOCK:
            parts.append(bands(group))
            group, load = [], 0
    if group:
        parts.append(bands(group))
    ends = np.concatenate([[0], np.cumsum([0 if d is None else BANDS for d in digests])]).astype(np.int32)
    flat = np.concatenate([p.ravel() for p in parts]) if parts else np.zeros(0, np.int64)
    return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["words", "bands"])


def _profiles(texts: pa.Array) -> pa.Array:
    rows = [np.bincount((e % np.uint64(BINS)).astype(np.int64), w, BINS).astype(np.int32)
            for e, w in (weighted_shingles(t) for t in each(texts))]
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BINS), pa.array(flat))


def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    last, of_last, out = None, None, []
    for x, y in zip(each(a), each(b)):
        if last is None or x != last:  # pairs of one text often follow each other
            last, of_last = x, weighted_shingles(x)
        out.append(similarity(of_last, weighted_shingles(y)) >= THRESHOLD)
    return pa.array(out, pa.bool_())


def signed(text: str = "text") -> Column:
    """Struct of the digest of the text's words in order and the array of its band hashes."""
    return F.arrow_udf(_signed, "struct<words:binary,bands:array<bigint>>")(F.col(text))


def profile(text: str = "text") -> Column:
    """Array of the shingles' weights in each hash bin."""
    return F.arrow_udf(_profiles, "array<int>")(F.col(text))


def _candidates(table: pa.Table) -> pa.Table:
    """Pairs of one block (outside rows x all rows) whose profiles don't rule out the threshold.

    Weight shared <= sum of the smaller bins, so similarity <= shared / (both - shared).  Compared in
    integers, as a pair at exactly the threshold must stay."""
    part = {name: table.column(name).to_numpy() for name in ("node", "comp", "main", "outside")}
    bins = table.column("profile").combine_chunks().flatten().to_numpy().reshape(-1, BINS)
    weight = bins.sum(axis=1)
    first, second = np.nonzero(part["outside"])[0], np.nonzero(~part["outside"])[0]
    out_a, out_b = [], []
    for i in first:
        low, high = np.minimum(weight[second], weight[i]), np.maximum(weight[second], weight[i])
        other = part["comp"][second]
        # a pair of two outside rows is looked at from its smaller node only
        use = second[(low * OF >= high * PART) & (other != part["comp"][i]) & ((other == part["main"][second]) | (part["node"][i] < part["node"][second]))]
        shared = np.minimum(bins[use], bins[i]).sum(axis=1)
        use = use[shared * (OF + PART) >= (weight[use] + weight[i]) * PART]
        out_a.append(np.full(len(use), part["node"][i]))
        out_b.append(part["node"][use])
    none = [np.zeros(0, np.int64)]
    return pa.table({"a": pa.array(np.concatenate(none + out_a)), "b": pa.array(np.concatenate(none + out_b))})


def block_pairs(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) for the members (bucket, node, comp, n, main) of large buckets: each member outside of the
    bucket's largest component against all members of others, less the pairs their profiles rule out.

    A bucket is cut into about n / SIDE blocks of members by a hash; each pair of blocks is a group
    of its own, compared in one task by array operations.  Pairs are never expanded into rows."""
    rows = marked.join(texts.select("node", "profile"), "node").withColumn("blocks", F.ceil(F.col("n") / SIDE).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    outside = rows.filter("comp <> main").select("bucket", F.col("own").alias("i"), others.alias("j"), "node", "comp", "main", "profile", F.lit(True).alias("outside"))
    every = rows.select("bucket", others.alias("i"), F.col("own").alias("j"), "node", "comp", "main", "profile", F.lit(False).alias("outside"))
    return outside.union(every).groupBy("bucket", "i", "j").applyInArrow(_candidates, "a bigint, b bigint")


def copy_digest(text: str = "text") -> Column:
    """Digest of the whole text, by which rows are found again."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole texts (``texts``: node, text) are near duplicates; staged."""
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a")
    return staged(both.filter(F.arrow_udf(_similar, "boolean")("text_a", "text_b")).select("a", "b"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for the nodes that occur in ``links`` (a, b).

    Rounds of contraction: every node points to its smallest neighbour or
    itself, pointers are followed twice, and links are rewritten to the nodes
    pointed at, until none is left.  All tables are staged.
    """
    both = links.union(links.select("b", "a")).toDF("node", "other").distinct()
    labels, rest = None, both
    while True:
        low = rest.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("to"))
        low = staged(low, "cc-point")
        for _ in range(2):
            step = low.select(F.col("node").alias("to"), F.col("to").alias("next"))
            low = low.join(step, "to").select("node", F.col("next").alias("to"))
        low = staged(low, "cc-jump")
        if labels is None:
            labels = low.select("node", F.col("to").alias("label"))
        else:
            moved = labels.join(low.select(F.col("node").alias("label"), "to"), "label", "left")
            labels = staged(moved.select("node", F.coalesce("to", "label").alias("label")), "cc-labels")
        far = low.select(F.col("node").alias("other"), F.col("to").alias("to_other"))
        rest = rest.join(low, "node").join(far, "other").filter("to <> to_other") \
            .select(F.col("to").alias("node"), F.col("to_other").alias("other")).distinct()
        rest = staged(rest, "cc-links")
        if rest.isEmpty():
            return labels


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` (bucket, node) with each node's component."""
    with_label = members.join(labels, "node", "left")
    return with_label.select("bucket", "node", F.coalesce("label", "node").alias("comp"))


def near_links(members: DataFrame, texts: DataFrame, small: int = SMALL, pivots: int = PIVOTS) -> tuple:
    """(links found, component labels) for ``members`` (bucket, node) of buckets with two members or more;
    ``texts`` has node, text and profile."""
    first = members.groupBy("bucket").agg(F.min("node").alias("a"))
    star = members.join(first, "bucket").filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    links = verified(staged(star, "near-pairs"), texts)
    labels = components(links)
    left = members.join(first, "bucket").filter("node <> a").select("bucket", "node")
    for turn in range(pivots + 1):
        # the buckets whose remaining members lie in several components
        now = staged(_labelled(left, labels), "near-members")
        span = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"),
                                         F.min("node").alias("a")).filter("lo < hi")
        open_now = staged(now.join(span.drop("lo", "hi"), "bucket"), "near-open")
        if open_now.isEmpty():
            break
        few = open_now.filter(F.col("n") <= small).select("bucket", "node", "comp")
        other = few.select("bucket", F.col("node").alias("b"), F.col("comp").alias("comp_b"))
        pairs = few.join(other, "bucket").filter("node < b and comp <> comp_b").select(F.col("node").alias("a"), "b")
        many = open_now.filter(F.col("n") > small)
        if turn < pivots:
            heads = many.filter("node = a").select("bucket", F.col("comp").alias("comp_a"))
            more = many.join(heads, "bucket").filter("comp <> comp_a").select("a", F.col("node").alias("b"))
            left = many.filter("node <> a").select("bucket", "node")
        else:
            counts = many.groupBy("bucket", "comp").count().groupBy("bucket").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
            marked = many.join(counts, "bucket")
            more = block_pairs(marked, texts)
            left = None
        tested = staged(pairs.union(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
        links = staged(links.union(verified(tested, texts)).distinct(), "near-links")
        labels = components(links)
        if left is None:
            break
    return links, labels


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple:
    """(rows, classes): ``rows`` are staged narrow input rows (row, id, words, bands); ``classes`` maps words
    to node, class_id, class_size, keep_row.

    class_id is the smallest id of the class; the row that stays is the first with that id.  Whole texts
    are fetched once, for texts that share a bucket: documents meet them on (digest of the text, id), so that
    copies, which have different ids, are not gathered.
    """
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), copy_digest(text).alias("copy"),
                              signed(text).alias("s")).select("row", "id", "copy", "s.words", "s.bands"), "near-rows")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    nodes = rows.filter("words is not null").groupBy("words").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n"))
    nodes = staged(nodes.withColumn("node", F.col("best.row")), "near-nodes")
    # one row of each group of copies stands for it: rows meet nodes on the row id, which is unique
    heads = rows.select(F.col("row").alias("node"), "bands").join(nodes.select("node"), "node")
    members = heads.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = staged(members.join(shared, "bucket"), "near-buckets")
    wanted = rows.select(F.col("row").alias("node"), "copy", *id_key("id", "id")).join(members.select("node").distinct(), "node")
    whole = docs.select(copy_digest(text).alias("copy"), *id_key(key, "id"), F.col(text).alias("text"))
    same = ["copy", "id", "id_null"]
    texts = whole.join(wanted, same).dropDuplicates(same).select("node", "text")  # rows repeated whole meet here
    texts = staged(texts.withColumn("profile", profile("text")), "near-texts")
    labels = near_links(members, texts)[1]
    tagged = nodes.join(labels, "node", "left").select("words", "node", "best", "n", F.coalesce("label", "node").alias("label"))
    tagged = staged(tagged, "near-tagged")
    groups = staged(tagged.groupBy("label").agg(F.min("best").alias("best"), F.sum("n").alias("class_size")), "near-groups")
    mapped = tagged.drop("best").join(groups, "label").select("words", "node", F.col("best.id").alias("class_id"), "class_size",
                                                F.col("best.row").alias("keep_row"))
    return rows, staged(mapped, "near-classes")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, class_id, class_size (rows), kept."""
    rows, by_words = classes(docs, key, text)
    narrow = rows.select("row", "id", "words")
    found = narrow.filter("words is not null").join(by_words, "words").select(
        F.col("id").alias(key), "class_id", "class_size", (F.col("row") == F.col("keep_row")).alias("kept"))
    alone = narrow.filter("words is null").select(F.col("id").alias(key), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
                                                  F.lit(True).alias("kept"))
    return found.union(alone)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per class, with all their columns."""
    rows, by_words = classes(docs, key, text)
    first = by_words.filter("node = keep_row").select(F.col("keep_row").alias("row"))
    stay = rows.filter("words is not null").join(first, "row").select("copy", *id_key("id", "__id"))
    every = docs.select(F.struct("*").alias("__row"), *id_key(key, "__id"), copy_digest(text).alias("copy"),
                        (F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE.decode())) == "").alias("__blank"))
    same = ["copy", "__id", "__id_null"]
    # only rows repeated whole (same id and text) still meet in the window
    one = Window.partitionBy(*same).orderBy(F.xxhash64("__row"))
    kept = every.join(stay, same).withColumn("__n", F.row_number().over(one)).filter("__n = 1").select("__row.*")
    return kept.union(every.filter("__blank").select("__row.*"))

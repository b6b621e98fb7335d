"""Collocations: phrases that hold together, by counts in weighted acyclic automata.

Texts are cut into pieces at punctuation and line ends, pieces into words.  A phrase's count is
the number of its occurrences inside pieces, overlaps included.  Phrases of 2 to ``LONGEST``
words with at least ``LEAST`` occurrences are candidates.

Count transducers.  A transducer holds counted phrases as an acyclic automaton over words: a state per
distinct prefix, made where a sorted phrase leaves the prefix it shares with the one before it; the arc into
a state carries its word and the phrase's count; states without arcs are one final state.  Tasks
build one per shard (a bounded stretch of text of one language) from the shard's sorted phrases.

Union by prefix range.  Phrases in sorted order are cut into ranges of about ``RANGE`` entries, at phrases that
shards propose from their own order (any prefix can be cut, so a common first word or pair fills several ranges).
The parts of all shards in one range meet in one task, which sums the weights of equal phrases and
keeps those with ``LEAST`` occurrences or more.

Two passes.  The first counts single words and pairs.  A longer phrase can only be frequent if all its pairs
are, so the second pass counts phrases of 3 and more words whose pairs all pass a bit table of the frequent
pairs.  The table has at most ``TABLE_BITS`` bits: it may let other pairs pass, whose phrases
then fail the exact count, and never stops a frequent one.

Part lookups by composition.  For every range the parts of its candidates form an unweighted automaton, sent to the
ranges that hold them and composed with their transducers; the weights come back in the order of the parts.

Per language; a null language counts as ``und``.  Null and empty texts have no words.  Repeated rows count each time.
Long texts count whole, in stretches cut between pieces.  Empty tables give no rows.
"""

from __future__ import annotations

import bisect
import itertools
import pickle
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONGEST, LEAST, TOP = 4, 30, 2_000
#: Score of a phrase that never occurs without its parts.
UNIT = 1_000_000
#: A candidate inside a longer one goes if the longer has at least so many percent of its occurrences.
COVER = 80
#: Bytes of text in a shard, and entries of a range.
SHARD, RANGE = 6 << 20, 600_000
#: Phrases that a shard proposes as cuts, and the most that the driver looks at.
CUTS, MOST_CUTS = 48, 60_000
TABLE_BITS = 1 << 27
#: Every character that ends a piece becomes a full stop, a tab a space, A-Z become a-z.
FOLD = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
SHARDS = "lang string, words bigint, entries bigint, transducer binary, cuts binary"


# -- transducers ----------------------------------------------------------------

class Phrases:
    """Counted phrases in sorted order: ``cols`` has one row of word numbers per position, 0 behind a phrase's end.

    Words are in byte order, so sorted numbers are sorted phrases."""

    def __init__(self, words: list, cols: np.ndarray, counts: np.ndarray):
        self.words, self.cols, self.counts = words, cols, counts

    def __len__(self) -> int:
        return len(self.counts)

    def lengths(self) -> np.ndarray:
        return (self.cols > 0).sum(axis=0)

    def tuples(self, at=None) -> list:
        """The phrases as tuples of words."""
        cols = self.cols if at is None else self.cols[:, at]
        words = [None, *self.words]
        return [tuple(words[i] for i in row if i) for row in cols.T.tolist()]

    def first_at_or_after(self, phrase: tuple) -> int:
        """Number of phrases that sort before ``phrase``."""
        key = []
        for w in phrase:
            i = bisect.bisect_left(self.words, w)
            if i == len(self.words) or self.words[i] != w:
                key.append(i + 0.5)  # between two known words
                break
            key.append(i + 1)
        low, high = 0, len(self)
        while low < high:
            mid = (low + high) // 2
            if [c for c in self.cols[:, mid].tolist() if c] < key:
                low = mid + 1
            else:
                high = mid
        return low

    def part(self, a: int, b: int) -> "Phrases":
        return Phrases(self.words, self.cols[:, a:b], self.counts[a:b])


def in_order(cols: np.ndarray, size: int) -> np.ndarray:
    """Sorting order of columns of word numbers below ``size``."""
    bits, keys = max(1, int(size).bit_length()), []
    for first in range(0, len(cols), max(1, 62 // bits)):
        key = np.zeros(cols.shape[1], np.int64)
        for c in cols[first:first + max(1, 62 // bits)]:
            key = key << bits | c
        keys.append(key)
    return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])


def summed(words: list, cols: np.ndarray, counts: np.ndarray) -> Phrases:
    """Sorts phrases and adds up the counts of equal ones."""
    order = in_order(cols, len(words) + 1)
    cols, counts = cols[:, order], counts[order]
    new = np.ones(cols.shape[1], bool)
    new[1:] = (cols[:, 1:] != cols[:, :-1]).any(axis=0)
    at = np.flatnonzero(new)
    return Phrases(words, cols[:, at], np.add.reduceat(counts, at) if len(at) else counts)


def small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def transducer(p: Phrases) -> bytes:
    """The acyclic automaton of sorted phrases.

    Per depth: for each state of the depth before the number of its arcs, and for each arc its word and weight (0 if no phrase
    ends there).  A phrase opens a state at each depth past the prefix it shares with the phrase before it."""
    used = np.unique(p.cols[p.cols > 0])
    number = np.zeros(len(p.words) + 1, np.int64)
    number[used] = np.arange(len(used))
    lengths, levels = p.lengths(), []
    opens, parents, states = np.zeros(len(p), bool), np.zeros(len(p), np.int64), 1
    if len(p):
        opens[0] = True
    for d in range(int(lengths.max(initial=0))):
        opens[1:] |= p.cols[d, 1:] != p.cols[d, :-1]
        at = np.flatnonzero(opens & (lengths > d))
        weight = np.where(lengths[at] == d + 1, p.counts[at], 0)
        levels.append((small(np.bincount(parents[at], minlength=states)), small(number[p.cols[d, at]]), small(weight)))
        state = np.zeros(len(p), np.int64)
        state[at] = 1
        parents, states = np.cumsum(state) - 1, len(at)
    return pickle.dumps(([p.words[i - 1] for i in used.tolist()], levels), protocol=5)


class Transducer:
    """An automaton as read back: words and, per depth, parent state, word and weight of each arc, sorted."""

    def __init__(self, data: bytes):
        self.words, levels = pickle.loads(data)
        self.levels = [(np.repeat(np.arange(len(fan)), fan), label.astype(np.int64), weight.astype(np.int64)) for fan, label, weight in levels]

    def phrases(self) -> Phrases:
        """All phrases with a weight, in sorted order."""
        parts, prefix = [], np.zeros((0, 1), np.int64)
        for parent, label, weight in self.levels:
            prefix = np.vstack([prefix[:, parent], label + 1])
            at = np.flatnonzero(weight)
            cols = np.zeros((len(self.levels), len(at)), np.int64)
            cols[:len(prefix)] = prefix[:, at]
            parts.append((cols, weight[at]))
        if not parts:
            return Phrases(self.words, np.zeros((0, 0), np.int64), np.zeros(0, np.int64))
        cols, counts = np.hstack([c for c, _ in parts]), np.concatenate([w for _, w in parts])
        order = in_order(cols, len(self.words) + 1)
        return Phrases(self.words, cols[:, order], counts[order])

    def compose(self, parts: Phrases) -> np.ndarray:
        """Weight of each phrase of ``parts``: both automata are walked together, all phrases a word at a time."""
        number = {w: i for i, w in enumerate(self.words)}
        known = np.array([-1, *[number.get(w, -1) for w in parts.words]], np.int64)
        state, weight, size = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), len(self.words) + 1
        for d, column in enumerate(parts.cols):
            live = (column > 0) & (state >= 0)
            if d >= len(self.levels):
                weight[live] = 0
                break
            parent, label, weights = self.levels[d]
            arcs, want = parent * size + label, state * size + known[column]
            at = np.minimum(np.searchsorted(arcs, want), len(arcs) - 1)
            met = live & (known[column] >= 0) & (arcs[at] == want)
            weight[live] = np.where(met[live], weights[at][live], 0)
            state[live] = np.where(met[live], at[live], -1)
        return weight


def union(parts: list) -> Phrases:
    """One sorted list of the phrases of several, weights added up."""
    words = sorted(set().union(*[p.words for p in parts]))
    number = {w: i + 1 for i, w in enumerate(words)}
    deep = max(len(p.cols) for p in parts)
    cols = []
    for p in parts:
        renumbered = np.array([0, *[number[w] for w in p.words]], np.int64)[p.cols]
        cols.append(np.vstack([renumbered, np.zeros((deep - len(renumbered), len(p)), np.int64)]))
    return summed(words, np.hstack(cols), np.concatenate([p.counts for p in parts]))


# -- shards -----------------------------------------------------------------------

def stretches(texts: list):
    """Folded texts joined by full stops, cut behind full stops into stretches of about SHARD bytes."""
    whole, at = b".".join(t.encode("utf-8", "surrogatepass").translate(FOLD) for t in texts), 0
    while at < len(whole):
        end = whole.find(b".", at + SHARD) if len(whole) > at + SHARD else -1
        end = len(whole) if end < 0 else end
        yield whole[at:end]
        at = end + 1


def pair_places(lang: str, words: list, first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """Place of each pair of word numbers (from 1) in a table of ``bits`` bits."""
    h = np.array([0, *[xxhash.xxh3_64_intdigest(w) for w in words]], np.uint64)
    mixed = (h[first] ^ np.uint64(xxhash.xxh3_64_intdigest(lang))) * np.uint64(0x9E3779B97F4A7C15) + h[second]
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)) & np.uint64(bits - 1)


def count_stretch(lang: str, data: bytes, pairs: np.ndarray | None) -> tuple:
    """(number of words, counted phrases): words and pairs, or with a table of ``pairs`` phrases of 3 words and more."""
    tokens = data.replace(b".", b" . ").split()
    words = sorted(set(tokens) - {b"."})
    number = dict(zip(words, range(1, len(words) + 1)))
    ids = np.fromiter(map({**number, b".": 0}.__getitem__, tokens), np.int64, len(tokens))
    total = int(np.count_nonzero(ids))
    if pairs is None:
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        single, n_single = np.unique(ids[ids > 0], return_counts=True)
        base = len(words) + 1
        pair, n_pair = np.unique(ids[both] * base + ids[both + 1], return_counts=True)
        cols = np.vstack([np.r_[single, pair // base], np.r_[np.zeros(len(single), np.int64), pair % base]])
        return total, summed(words, cols, np.r_[n_single, n_pair])
    bits = len(pairs) * 64
    linked = (ids[:-1] > 0) & (ids[1:] > 0)
    at = np.flatnonzero(linked)
    place = pair_places(lang, words, ids[at], ids[at + 1], bits)
    linked[at] = (pairs[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
    parts, run = [], linked
    for n in range(3, LONGEST + 1):
        run = run[:-1] & linked[n - 2:] if len(run) else run
        at = np.flatnonzero(run)
        parts.append(np.vstack([*[ids[at + i] for i in range(n)], *[np.zeros(len(at), np.int64)] * (LONGEST - n)]))
    cols = np.hstack(parts)
    return total, summed(words, cols, np.ones(cols.shape[1], np.int64))


def shard_rows(pairs=None):
    """mapInArrow: (lang, text) to one row per shard.  ``pairs`` is a broadcast table of frequent pairs."""
    def run(batches):
        held, size = {}, 0

        def flush():
            for lang, texts in held.items():
                rows = []
                for data in stretches(texts):
                    total, p = count_stretch(lang, data, None if pairs is None else pairs.value)
                    every = max(1, len(p) // CUTS)
                    cuts = p.tuples(np.arange(every // 2, len(p), every))
                    rows.append((lang, total, len(p), transducer(p), pickle.dumps(cuts)))
                for row in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.string()), pa.array([row[1]], pa.int64()), pa.array([row[2]], pa.int64()),
                                                      pa.array([row[3]], pa.binary()), pa.array([row[4]], pa.binary())],
                                                     names=["lang", "words", "entries", "transducer", "cuts"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= SHARD:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()
    return run


# -- union by prefix range ----------------------------------------------------------

def choose_cuts(shards: DataFrame) -> list:
    """Sorted (lang, phrase) at which ranges end: weighted quantiles of the shards' proposals.

    The driver sees at most MOST_CUTS of them, from shards picked by a hash: they only balance the ranges."""
    count, entries = shards.agg(F.count("*"), F.coalesce(F.sum("entries"), F.lit(0))).first()
    ranges = -(-entries // RANGE)
    if ranges <= 1:
        return []
    some = max(1, MOST_CUTS // CUTS)
    picked = shards.select("lang", "entries", "cuts")
    if count > some:
        picked = picked.orderBy(F.xxhash64("cuts")).limit(some)
    seen = []
    for r in picked.collect():
        cuts = pickle.loads(r["cuts"])
        seen += [(r["lang"].encode(), c, r["entries"] / max(1, len(cuts))) for c in cuts]
    seen.sort(key=lambda x: x[:2])
    ends = np.cumsum([x[2] for x in seen])
    at = np.searchsorted(ends, ends[-1] * np.arange(1, ranges) / ranges) if seen else []
    return [k for k, _ in itertools.groupby(seen[i][:2] for i in at)]


def range_bounds(cuts: list, lang: str) -> tuple:
    """(number of the first range of a language, phrases at which its further ranges begin)."""
    code = lang.encode()
    first = bisect.bisect_left(cuts, (code, ()))
    return first, [c for of, c in cuts[first:bisect.bisect_left(cuts, (code + b"\0", ()))] if of == code]


def by_range(p: Phrases, first: int, bounds: list):
    """(range number, the phrases in it)."""
    at = [0, *[p.first_at_or_after(b) for b in bounds], len(p)]
    for i, (a, b) in enumerate(zip(at, at[1:])):
        if b > a:
            yield first + i, p.part(a, b)


def merge_shards(shards: DataFrame, least: int, tag: str) -> tuple:
    """(index, cuts): one merged transducer per range and language, staged, with the phrases counted ``least`` times or more."""
    cuts = choose_cuts(shards)

    def split(batches):
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(r, transducer(p)) for r, p in by_range(Transducer(data).phrases(), *range_bounds(cuts, lang))]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([lang] * len(rows), pa.string()),
                                                  pa.array([t for _, t in rows], pa.binary())], names=["range", "lang", "transducer"])

    def merge(key, table):
        p = union([Transducer(t).phrases() for t in table.column("transducer").to_pylist()])
        often = np.flatnonzero(p.counts >= least)
        kept = Phrases(p.words, p.cols[:, often], p.counts[often])
        if not len(kept):
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.string(), pa.int64(), pa.binary())], ["range", "lang", "phrases", "transducer"])
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()]), pa.array([len(kept)], pa.int64()),
                         pa.array([transducer(kept)], pa.binary())], ["range", "lang", "phrases", "transducer"])

    parts = shards.select("lang", "transducer").mapInArrow(split, "range int, lang string, transducer binary")
    return staged(parts.groupBy("range", "lang").applyInArrow(merge, "range int, lang string, phrases bigint, transducer binary"), tag), cuts


def pair_table(index: DataFrame) -> np.ndarray:
    """Bits of the frequent pairs, as unsigned 64-bit words; at most TABLE_BITS bits whatever the input."""
    phrases = index.agg(F.coalesce(F.sum("phrases"), F.lit(0))).first()[0]
    bits = min(TABLE_BITS, max(1 << 12, 1 << int(16 * phrases).bit_length()))

    def places(batches):
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = Transducer(data).phrases()
                at = np.flatnonzero(p.lengths() == 2)
                if len(at):
                    place = pair_places(lang, p.words, p.cols[0, at], p.cols[1, at], bits)
                    words, inverse = np.unique(place >> np.uint64(6), return_inverse=True)
                    value = np.zeros(len(words), np.uint64)
                    np.bitwise_or.at(value, inverse, np.uint64(1) << (place & np.uint64(63)))
                    yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])

    rows = index.select("lang", "transducer").mapInArrow(places, "word bigint, value bigint").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[rows.column("word").to_numpy()] = rows.column("value").to_numpy()
    return table.view(np.uint64)


# -- scores ---------------------------------------------------------------------------

def parts_of(p: Phrases) -> tuple:
    """(parts, refs): the distinct first and last parts of all phrases, and per phrase and cut their numbers."""
    lengths, chosen, ref = p.lengths(), [], []
    for k in range(1, LONGEST):
        at = np.flatnonzero(lengths > k)
        for side in (0, 1):
            cols = np.zeros((LONGEST - 1, len(at)), np.int64)
            taken = p.cols[:k, at] if side == 0 else p.cols[k:, at]
            cols[:min(len(taken), LONGEST - 1)] = taken[:LONGEST - 1]
            chosen.append(cols)
            ref.append((k, side, at))
    cols = np.hstack(chosen)
    order = in_order(cols, len(p.words) + 1)
    new = np.ones(len(order), bool)
    new[1:] = (cols[:, order][:, 1:] != cols[:, order][:, :-1]).any(axis=0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    parts = Phrases(p.words, cols[:, order[new]], np.ones(int(new.sum()), np.int64))
    refs, start = {}, 0
    for k, side, at in ref:
        refs[k, side] = at, number[start:start + len(at)]
        start += len(at)
    return parts, refs


def long_enough(p: Phrases) -> Phrases:
    at = np.flatnonzero(p.lengths() >= 2)
    return Phrases(p.words, p.cols[:, at], p.counts[at])


def score_rows(p: Phrases, weights: np.ndarray, refs: dict) -> list:
    """(phrase, number of words, a, l, r, score) of every phrase at its lowest-scoring cut, in whole numbers of any size."""
    best: list = [None] * len(p)
    a = p.counts.tolist()
    for k in range(1, LONGEST):
        (at, left), (_, right) = refs[k, 0], refs[k, 1]
        for i, l, r in zip(at.tolist(), weights[left].tolist(), weights[right].tolist()):
            score = 2 * UNIT * a[i] // (l + r)
            if best[i] is None or score < best[i][2]:
                best[i] = l, r, score
    return [(b" ".join(t).decode("utf-8", "surrogatepass"), len(t), n, *b) for t, n, b in zip(p.tuples(), a, best)]


def scored(short: tuple, long: tuple) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of all candidates; ``short`` and ``long`` are what merge_shards gave for either pass.

    Requests: the distinct parts of one range's candidates, cut by the ranges that hold them.  Answers: their weights
    in the same order.  Parts of one and two words lie in the first index, longer ones in the second."""
    (short_index, short_cuts), (long_index, long_cuts) = short, long
    index = short_index.withColumn("pass", F.lit(0)).unionByName(long_index.withColumn("pass", F.lit(1)))

    def ask(batches):
        for batch in batches:
            for src, of, lang, data in zip(*[c.to_pylist() for c in batch.columns]):
                p = long_enough(Transducer(data).phrases())
                if not len(p):
                    continue
                parts, lengths, rows = parts_of(p)[0], None, []
                lengths = parts.lengths()
                for where, cuts, mine in ((0, short_cuts, lengths <= 2), (1, long_cuts, lengths > 2)):
                    at = np.flatnonzero(mine)
                    chosen = Phrases(parts.words, parts.cols[:, at], parts.counts[at])
                    if len(at):
                        rows += [(r, where, transducer(x)) for r, x in by_range(chosen, *range_bounds(cuts, lang))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([lang] * len(rows), pa.string()),
                     pa.array([src] * len(rows), pa.int32()), pa.array([of] * len(rows), pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                    names=["range", "pass", "lang", "src", "src_pass", "parts"])

    def answer(key, asked, held):
        table = Transducer(held.column("transducer")[0].as_py()) if len(held) else Transducer(pickle.dumps(([], [])))
        weights = [table.compose(Transducer(x).phrases()).tobytes() for x in asked.column("parts").to_pylist()]
        return pa.table([asked.column("src"), asked.column("src_pass"), asked.column("lang"), asked.column("range"), asked.column("pass"),
                         pa.array(weights, pa.binary())], ["src", "src_pass", "lang", "range", "pass", "weights"])

    def finish(key, held, answers):
        lang, rows = key[2].as_py(), []
        p = long_enough(Transducer(held.column("transducer")[0].as_py()).phrases())
        if len(p):
            parts, refs = parts_of(p)
            lengths, weights = parts.lengths(), np.zeros(len(parts), np.int64)
            got = {(r["pass"], r["range"]): np.frombuffer(r["weights"], np.int64) for r in answers.to_pylist()}
            for where, mine in ((0, lengths <= 2), (1, lengths > 2)):
                at = np.flatnonzero(mine)
                if len(at):
                    weights[at] = np.concatenate([got[k] for k in sorted(k for k in got if k[0] == where)])
            rows = score_rows(p, weights, refs)
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array([lang] * len(rows), pa.string()), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]],
                        ["lang", "phrase", "words", "a", "l", "r", "score"])

    asked = index.select("range", "pass", "lang", "transducer").mapInArrow(
        ask, "range int, pass int, lang string, src int, src_pass int, parts binary")
    place = ["range", "pass", "lang"]
    answers = asked.groupBy(*place).cogroup(index.groupBy(*place)).applyInArrow(
        answer, "src int, src_pass int, lang string, range int, pass int, weights binary")
    return index.groupBy(*place).cogroup(answers.groupBy("src", "src_pass", "lang")).applyInArrow(
        finish, "lang string, phrase string, words int, a bigint, l bigint, r bigint, score bigint")


def inner_phrases(phrase: Column) -> Column:
    """The shorter phrases of two words and more inside a phrase."""
    words = F.split(phrase, " ")
    spans = [(i, n) for n in range(2, LONGEST) for i in range(LONGEST - n + 1)]
    inside = [F.when((F.size(words) > n) & (F.size(words) >= i + n), F.concat_ws(" ", F.slice(words, i + 1, n))) for i, n in spans]
    return F.array_compact(F.array(*inside))


def best_rows(rows: DataFrame, group: str, order: list, tie: str, top: int, count: int) -> DataFrame:
    """The ``top`` rows of each group in ``order``, with their ``rank``.

    No task holds a whole group: rows are dealt into buckets of about 10 * top, each of which
    keeps its best, again and again until what is left fits one bucket."""
    level = 0
    while count > 10 * top:
        buckets = -(-count // (10 * top))
        rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(tie, F.lit(level)), F.lit(buckets)))
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(*order))) \
            .filter(F.col("__n") <= top).drop("__bucket", "__n")
        count, level = buckets * top, level + 1
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` candidates of each language that no longer one covers."""
    texts = docs.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    shards = staged(texts.mapInArrow(shard_rows(), SHARDS), "shards")
    short = merge_shards(shards, least, "short-phrases")
    table = docs.sparkSession.sparkContext.broadcast(pair_table(short[0]))
    long = merge_shards(staged(texts.mapInArrow(shard_rows(table), SHARDS), "long-shards"), least, "long-phrases")
    found = staged(scored(short, long), "candidates")
    covers = found.filter(F.col("words") > 2).select(F.col("lang").alias("in_lang"), F.explode(inner_phrases(F.col("phrase"))).alias("inner"), "a") \
        .groupBy("in_lang", "inner").agg(F.max("a").alias("most"))
    on = (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inner"))
    covered = F.col("most").cast("decimal(38,0)") * 100 >= F.col("a").cast("decimal(38,0)") * COVER
    left = found.join(covers, on, "left").filter(~F.coalesce(covered, F.lit(False)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = best_rows(left, "lang", order, "phrase", top, found.count())
    totals = shards.groupBy(F.col("lang").alias("of")).agg(F.sum("words").alias("n"))
    return ranked.join(totals, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Secret scan: fixed patterns and a randomness test battery (DataFrame operations only).

Base spans come from three patterns: assignments of a value of 8 or more
characters to a password-like name, access keys, and hex strings of 32 or more.
Matches are leftmost and do not overlap within a kind; those too short are dropped
after matching.

The method adds spans of kind ``random``.  Runs of 20 or more characters of the usual
encodings are cut: base spans are taken out, and a ``=`` that more symbols follow (NAME=value)
ends a part.  A part that mixes the signs of base64 and URL-safe base64 is read three
ways: cut at ``/``, ``_`` and ``-``, as runs of base64 and as runs of URL-safe base64.
Every piece of 20 or more characters (padding included) is a candidate.  For each, the smallest fitting
encoding is inferred (decimal, hex, base32, base36, base64, URL-safe base64) and
its symbols are held against the hypothesis "uniform and independent" by three
tests: chi-squared of the symbol counts, runs above and below the middle of the
alphabet, and serial correlation of neighbours.  A candidate that any test
rejects at BATTERY / 3 is not random.

Passing tests alone says little for a short string, so each candidate also gets
evidence against "ordinary text", a chain of character classes (lower, upper,
digit, sign) that stays in its class with probability STAY: the likelihood ratio
of the encoding's uniform model to that chain, whose inverse bounds the p-value.
It grows with length by itself.  False discoveries are controlled by the
Benjamini-Hochberg rule at FDR, separately per band of length, over the candidates of the
whole corpus; p-values are rounded up to tenths of a power of ten, so the rule
needs a table of bounded size only.  Where readings of one part that overlap are found,
the one with most evidence stays.

Positions are code points, end exclusive.  The work grows with the number of matches of a text, not with its square.
Null text counts as empty and has no spans.  Repeated rows are scanned each for itself and all count for the rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import full_text, staged

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE = 8
LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Symbols up to an inner "=", with their padding.
PART = r"[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_=-]))?"
#: Parts that one encoding fits, and the readings of the others.
FITTING = r"^(?:[A-Za-z0-9+/]+|[A-Za-z0-9_-]+)=*$"
READINGS = (r"[A-Za-z0-9+]+=*", r"[A-Za-z0-9+/]+=*", r"[A-Za-z0-9_-]+=*")
LOWER, UPPER, DIGIT, SIGN = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/-_"
#: (pattern, alphabet) from the smallest encoding to the largest.
ENCODINGS = (("[0-9]+", DIGIT), ("[0-9a-f]+", DIGIT + "abcdef"), ("[0-9A-F]+", DIGIT + "ABCDEF"), ("[A-Z2-7]+", UPPER + "234567"),
             ("[0-9a-z]+", DIGIT + LOWER), ("[0-9A-Z]+", DIGIT + UPPER), ("[A-Za-z0-9+/]+", UPPER + LOWER + DIGIT + "+/"),
             ("[A-Za-z0-9_-]+", UPPER + LOWER + DIGIT + "-_"))
BATTERY, FDR = 0.01, 0.01
STAY, MOVE = 0.85, 0.05
#: First length of each band of the false-discovery rule.
LENGTHS = (20, 32, 48, 96)
#: Smallest p-value told apart: 10 ** -MOST.
MOST = 60
#: Values of an array that are gathered at a time.
BLOCK = 256


def along(items: Column, kind: str, step) -> Column:
    """Array of (at, out) states along an array: ``step(at, x)`` gives the next ``at`` (from 0) and one value of type ``kind``.

    An array that grows is copied with each value, so values are gathered BLOCK at a time; the work
    grows in proportion to the array.  The last state's ``at`` is where the walk ends."""
    none = F.array().cast(f"array<{kind}>")

    def inner(acc, x):
        after, value = step(acc["at"], x)
        return F.struct(after.alias("at"), F.concat(acc["out"], F.array(value)).alias("out"))

    def walk(whole):
        def outer(acc, i):
            first = F.struct(F.element_at(acc, -1)["at"].alias("at"), none.alias("out"))
            return F.concat(acc, F.array(F.aggregate(F.slice(whole, i * BLOCK + 1, BLOCK), first, inner)))
        blocks = F.slice(F.sequence(F.lit(0), F.floor(F.size(whole) / BLOCK).cast("int")), F.lit(1), F.ceil(F.size(whole) / BLOCK).cast("int"))
        return F.aggregate(blocks, F.array(F.struct(F.lit(0).alias("at"), none.alias("out"))), outer)
    # bound to a variable, so that the array is computed once
    return F.element_at(F.transform(F.array(items), walk), 1)


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, match, part) of a pattern's matches; ``part`` is the given group.

    What lies between matches comes from ``split``, the matches from
    ``regexp_extract_all``; positions are running sums of their lengths.
    """
    between = F.split(text, pattern, -1)
    found = F.arrays_zip(between.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    kind = "struct<start:int,end:int,match:string,part:string>"

    def step(at, x):
        start = at + F.length(x["gap"])
        end = start + F.length(x["match"])
        return end, F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), x["part"].alias("part"))

    # arrays_zip pads the last gap, which no match follows
    states = along(F.filter(found, lambda x: x["match"].isNotNull()), kind, step)
    return F.when(text.rlike(pattern), F.flatten(F.transform(states, lambda s: s["out"]))).otherwise(F.array().cast(f"array<{kind}>"))


def _of_kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Staged: row, id, base spans and runs (start, match, base spans it touches) of every document."""
    whole = full_text(text)
    assign = F.filter(spans(whole, ASSIGN, 2), lambda x: F.length(x["part"]) >= ASSIGN_VALUE)
    base = F.concat(_of_kind(assign, "assign"), _of_kind(spans(whole, ACCESS), "access"), _of_kind(spans(whole, HEX), "hex"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.array_sort(base).alias("base"),
                       spans(whole, CANDIDATE).alias("found"))
    # base spans in blocks with their reach, so that a run looks at the blocks it touches only
    numbers = F.slice(F.sequence(F.lit(0), F.floor(F.size("base") / BLOCK).cast("int")), F.lit(1), F.ceil(F.size("base") / BLOCK).cast("int"))
    parts = F.transform(numbers, lambda i: F.slice("base", i * BLOCK + 1, BLOCK))
    blocks = F.transform(parts, lambda p: F.struct(p.alias("part"), F.element_at(p, 1)["start"].alias("low"), F.array_max(F.transform(p, lambda b: b["end"])).alias("top")))
    rows = staged(rows.withColumn("blocks", blocks), "secret-spans")

    def hits(x):
        first, end = x["start"], x["start"] + F.length(x["match"])
        near = F.filter("blocks", lambda k: (k["low"] < end) & (first < k["top"]))
        return F.flatten(F.transform(near, lambda k: F.filter(k["part"], lambda b: (b["start"] < end) & (first < b["end"]))))

    run = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["match"].alias("match"), hits(x).alias("hits")))
    return rows.select("row", "id", "base", run.alias("found"))


def _without(match: Column, start: Column, hits: Column) -> Column:
    """``match`` with blanks in place of base spans."""
    def step(at, b):
        first = F.greatest(b["start"] - start, at)
        end = F.greatest(F.least(b["end"] - start, F.length(match)), first)
        return end, F.concat(F.substring(match, at + 1, first - at), F.repeat(F.lit(" "), end - first))

    states = along(hits, "string", step)
    cut = F.element_at(F.transform(F.array(states), lambda w: F.concat(
        F.array_join(F.flatten(F.transform(w, lambda s: s["out"])), ""), F.substring(match, F.element_at(w, -1)["at"] + 1, F.length(match)))), 1)
    return F.when(F.size(hits) == 0, match).otherwise(cut)


def candidates(runs: DataFrame) -> DataFrame:
    """(row, part, start, end, match) of every candidate in runs (row, start, match, hits); ``part`` is where its part starts."""
    def enough(found):
        return F.filter(found, lambda x: F.length(x["match"]) >= LEAST)

    clear = runs.select("row", "start", _without(F.col("match"), F.col("start"), F.col("hits")).alias("clear"))
    parts = clear.select("row", "start", F.explode(enough(spans(F.col("clear"), PART))).alias("p"))
    parts = parts.select("row", (F.col("start") + F.col("p.start")).alias("part"), F.col("p.match").alias("match"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("match").alias("end"), F.col("match").alias("match"), F.col("match").alias("part")))
    read = F.array_distinct(F.concat(*[enough(spans(F.col("match"), pattern)) for pattern in READINGS]))
    pieces = parts.select("row", "part", F.explode(F.when(F.col("match").rlike(FITTING), whole).otherwise(read)).alias("p"))
    return pieces.select("row", "part", (F.col("part") + F.col("p.start")).alias("start"), (F.col("part") + F.col("p.end")).alias("end"), "p.match")


def normal_tail(z: Column) -> Column:
    """P(|Z| > |z|) by a logistic form of the normal distribution (error below 0.0002)."""
    a = F.abs(z)
    return F.lit(2.0) / (F.lit(1.0) + F.exp(a * 1.5976 + a * a * a * 0.070565992))


def evidence(found: DataFrame) -> DataFrame:
    """Adds n, k, p_chi, p_runs, p_serial and ln_ratio to rows with a ``match``."""
    core = F.regexp_replace("match", "=+$", "")
    alphabet = F.lit(None).cast("string")
    for pattern, symbols in reversed(ENCODINGS):
        alphabet = F.when(F.col("core").rlike(f"^{pattern}$"), F.lit(symbols)).otherwise(alphabet)
    t = found.withColumn("core", core).withColumn("alphabet", alphabet).filter(F.col("alphabet").isNotNull() & (F.length("core") >= 2))
    classes = F.translate("core", LOWER + UPPER + DIGIT + SIGN, "a" * 26 + "A" * 26 + "0" * 10 + "+" * 4)
    t = t.withColumn("n", F.length("core")).withColumn("k", F.length("alphabet")) \
        .withColumn("x", F.expr("transform(filter(split(core, ''), c -> c <> ''), c -> position(c, alphabet) - 1)")) \
        .withColumn("c", F.filter(F.split(classes, ""), lambda c: c != ""))
    t = t.withColumn("y", F.expr("slice(x, 2, n)")).withColumn("d", F.expr("slice(c, 2, n)"))
    # chi-squared of counts, by the cube-root approximation
    squares = F.expr("aggregate(array_distinct(x), 0D, (s, v) -> s + power(size(filter(x, w -> w = v)), 2))")
    t = t.withColumn("chi", squares * F.col("k") / F.col("n") - F.col("n"))
    df = F.col("k") - 1
    chi_z = (F.cbrt(F.col("chi") / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    p_chi = F.when(chi_z > 0, normal_tail(chi_z) / 2).otherwise(F.lit(0.5))
    # runs above and below the middle of the alphabet
    t = t.withColumn("high", F.expr("size(filter(x, v -> 2 * v >= k))").cast("double"))
    t = t.withColumn("turns", F.expr("aggregate(zip_with(slice(x, 1, n - 1), y, (a, b) -> if((2 * a >= k) <> (2 * b >= k), 1, 0)), 0, (s, v) -> s + v)"))
    product = 2 * F.col("high") * (F.col("n") - F.col("high"))
    expected = product / F.col("n") + 1
    variance = product * (product - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    p_runs = F.when(variance > 0, normal_tail((F.col("turns") + 1 - expected) / F.sqrt(variance))).otherwise(F.lit(0.0))
    # lag-one serial correlation
    t = t.withColumn("mean", F.expr("aggregate(x, 0D, (s, v) -> s + v) / n"))
    t = t.withColumn("spread", F.expr("aggregate(x, 0D, (s, v) -> s + power(v - mean, 2))"))
    lag = F.expr("aggregate(zip_with(slice(x, 1, n - 1), y, (a, b) -> (a - mean) * (b - mean)), 0D, (s, v) -> s + v)")
    p_serial = F.when(F.col("spread") > 0, normal_tail(lag / F.col("spread") * F.sqrt("n"))).otherwise(F.lit(0.0))
    # uniform symbols against a chain of classes
    for sign, symbols in (("a", LOWER), ("A", UPPER), ("0", DIGIT), ("+", SIGN)):
        inside = F.length(F.translate("alphabet", "".join(s for s in LOWER + UPPER + DIGIT + SIGN if s not in symbols), ""))
        t = t.withColumn(f"ln_{ord(sign)}", F.when(inside > 0, F.log(inside / F.col("k"))))
    ln = "case b when 'a' then ln_97 when 'A' then ln_65 when '0' then ln_48 else ln_43 end"
    ratio = F.expr(f"aggregate(zip_with(slice(c, 1, n - 1), d, (a, b) -> {ln} - if(a = b, {math.log(STAY)}D, {math.log(MOVE)}D)), 0D, (s, v) -> s + v)")
    return t.withColumn("p_chi", p_chi).withColumn("p_runs", p_runs).withColumn("p_serial", p_serial).withColumn("ln_ratio", ratio)


def discoveries(tested: DataFrame) -> DataFrame:
    """The rows of ``evidence`` that pass the battery and the false-discovery rule."""
    power = F.floor(F.least(F.greatest(F.col("ln_ratio") / math.log(10), F.lit(0.0)), F.lit(float(MOST))) * 10).cast("int")
    band = F.lit(0)
    for i, first in enumerate(LENGTHS):
        band = F.when(F.col("n") >= first, F.lit(i)).otherwise(band)
    rated = tested.withColumn("power", power).withColumn("band", band)
    counts = rated.groupBy("band", "power").agg(F.count(F.lit(1)).alias("m"))  # at most bands x (10 * MOST + 1) rows
    upward = Window.partitionBy("band").orderBy(F.col("power").desc())
    ranked = counts.withColumn("rank", F.sum("m").over(upward)).withColumn("all", F.sum("m").over(Window.partitionBy("band")))
    allowed = ranked.filter(F.pow(F.lit(10.0), -F.col("power") / 10) * F.col("all") <= F.lit(FDR) * F.col("rank"))
    limits = allowed.groupBy(F.col("band").alias("of")).agg(F.min("power").alias("least"))
    passed = rated.filter((F.col("p_chi") >= BATTERY / 3) & (F.col("p_runs") >= BATTERY / 3) & (F.col("p_serial") >= BATTERY / 3))
    return passed.join(F.broadcast(limits), F.col("band") == F.col("of")).filter(F.col("power") >= F.col("least"))


def apart(found: DataFrame) -> DataFrame:
    """(row, start, end) of the found pieces; of those of one part that overlap, the one with most evidence."""
    one = F.struct((-F.col("ln_ratio")).alias("less"), "start", "end")
    kind = "array<struct<less:double,start:int,end:int>>"

    def step(acc, x):
        met = F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        return F.when(met, acc).otherwise(F.concat(acc, F.array(x)))

    best = F.aggregate(F.array_sort(F.collect_list(one)), F.array().cast(kind), step)
    return found.groupBy("row", "part").agg(best.alias("best")).select("row", F.explode("best").alias("b")).select("row", "b.start", "b.end")


def listed(found: Column) -> Column:
    """kind:start:end of (start, kind, end) spans in order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"),
                                                                 x["end"].cast("string"))), ",")


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, base spans, all spans (arrays of (start, kind, end), in order)."""
    rows = scan(docs, key, text)
    runs = rows.select("row", F.explode("found").alias("f")).select("row", "f.start", "f.match", "f.hits")
    tested = evidence(candidates(runs)).select("row", "part", "start", "end", "n", "p_chi", "p_runs", "p_serial", "ln_ratio")
    found = apart(discoveries(staged(tested, "secret-tests")))
    one = F.struct("start", F.lit(KINDS.index("random")).alias("kind"), "end")
    added = found.groupBy("row").agg(F.collect_list(one).alias("added"))
    both = rows.select("row", F.col("id").alias(key), "base").join(added, "row", "left")
    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return both.select(key, "base", every.alias("spans"))


def count_of(found: str, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == KINDS.index(kind))).cast("long")

"""Quality rules with risk-controlled cutoffs.

Base rules reject a text with fewer than ``MIN_WORDS`` words, or with more
than half of its words in repeated 3-word windows.  On top of them a family of
rules, indexed by a cutoff c, rejects a text when any of its shares (symbols,
exclamation marks, upper-case letters, repeated lines, repeated words) reaches
c times that share's ``SCALES`` entry: the score of a text is the largest
share / scale, and it is rejected when score >= c.

Cutoffs are chosen per stratum (band of text length) on labelled holdouts: of
the n good documents (quality 1, base rules passed) of a stratum, k have a
score of at least c.  The exact binomial test P(Bin(n, ALPHA) <= k) <= DELTA /
(strata x cutoffs) certifies that the false rejection rate is at most ALPHA
(the Clopper-Pearson upper bound is below ALPHA); the Bonferroni correction
makes all certificates hold together with probability 1 - DELTA, so any of
the certified cutoffs may be picked: the one with the best share of rejected
bad minus rejected good documents, ties to the most lenient.  A stratum
without a certified cutoff rejects nothing beyond the base rules.

No model is fitted, so all labelled rows serve as the holdout.  Null text has
no words and fails the base rules, as does empty text.  Rows without a label,
with a null id or in an empty labels table do not take part in the choice; a
document labelled more than once counts by its lowest label.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .worker import SPACE, each, release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = UPPER + UPPER.lower()
#: Share of each kind at which a text scores 1.  Repetition alone is common in good texts; the base rules judge it.
SCALES = {"symbols": 0.10, "marks": 0.10, "upper": 0.30, "lines": 0.90, "repeats": 0.90}
CUTOFFS = tuple(0.25 * i for i in range(1, 17))
#: First word count of each stratum.
STRATA = (0, 150, 600)
#: Highest false rejection rate, and the chance that any certificate is wrong.
ALPHA, DELTA = 0.05, 0.1
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks", "n_upper", "n_letters")
MEASURE_TYPE = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"


def repeat_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more in ``words``."""
    if len(words) < 4:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    which, counts = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)[1:]
    twice = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:len(words) - 2 + k] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple:
    """The values of MEASURES for a whole text."""
    if text is None:
        return (0,) * len(MEASURES)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    without = lambda chars: len(data) - len(data.translate(None, chars))
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    return (len(words), len(text) - without(SPACE), without(SYMBOLS), len(lines), len(lines) - len(set(lines)),
            repeat_words(words), data.count(b"!"), without(UPPER), without(LETTERS))


def _measures(texts: pa.Array) -> pa.Array:
    release()
    rows = [measure(t) for t in each(texts)]
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
    return pa.StructArray.from_arrays(columns, list(MEASURES))


def measures(text: str = "text") -> Column:
    return F.arrow_udf(_measures, MEASURE_TYPE)(F.col(text))


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (F.col(f"{m}.n_repeat_words") * 100 > F.col(f"{m}.n_words") * 50)


def score(m: str) -> Column:
    """The largest share in units of its scale."""
    share = lambda a, b: F.when(F.col(f"{m}.{b}") > 0, F.col(f"{m}.{a}") / F.col(f"{m}.{b}")).otherwise(F.lit(0.0))
    shares = {"symbols": share("n_symbols", "word_chars"), "marks": share("n_marks", "word_chars"),
              "upper": share("n_upper", "n_letters"), "lines": share("n_dup_lines", "n_lines"),
              "repeats": share("n_repeat_words", "n_words")}
    return F.greatest(*[shares[k] / F.lit(v) for k, v in SCALES.items()])


def stratum(m: str) -> Column:
    out = F.lit(0)
    for i, first in enumerate(STRATA):
        out = F.when(F.col(f"{m}.n_words") >= first, F.lit(i)).otherwise(out)
    return out


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    top = math.lgamma(n + 1)
    logs = [top - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    most = max(logs)
    return min(1.0, math.exp(most) * math.fsum(math.exp(x - most) for x in logs))


def choose_cutoffs(counts: dict, alpha: float = ALPHA, delta: float = DELTA) -> dict:
    """{stratum: cutoff} from {(stratum, number of cutoffs reached, quality): documents}."""
    chosen = {}
    for s in range(len(STRATA)):
        of = {q: [counts.get((s, b, q), 0) for b in range(len(CUTOFFS) + 1)] for q in (0, 1)}
        good, bad = sum(of[1]), sum(of[0])
        best = None
        for i, c in enumerate(CUTOFFS):
            k, hit = sum(of[1][i + 1:]), sum(of[0][i + 1:])
            # a rate above alpha among the good documents can't be certified; skips the long sum
            if not good or k >= alpha * good or binomial_cdf(k, good, alpha) > delta / (len(STRATA) * len(CUTOFFS)):
                continue
            gain = (hit / bad if bad else 0.0) - k / good
            if best is None or gain >= best[0]:
                best = gain, c
        if best is not None:
            chosen[s] = best[1]
    return chosen


def fit(measured: DataFrame, labels: DataFrame, m: str = "m", key: str = "doc_id") -> dict:
    """Cutoffs per stratum; ``measured`` has the key and the struct ``m``.

    The driver gets counts only: strata x cutoffs x 2 rows at most.
    """
    reached = sum((F.col("__score") >= c).cast("int") for c in CUTOFFS)
    marks = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col(key).alias("__id")).agg(F.min("quality").alias("__q"))
    rated = measured.filter(~base_failed(m)).select(F.col(key).alias("__key"), stratum(m).alias("__s"), score(m).alias("__score"))
    rows = rated.join(marks, F.col("__key") == F.col("__id")).groupBy("__s", reached.alias("__b"), "__q").count().collect()
    return choose_cutoffs({(r["__s"], r["__b"], r["__q"]): r["count"] for r in rows})


def cutoff(m: str, chosen: dict) -> Column:
    out = F.lit(None).cast("double")
    for s, c in chosen.items():
        out = F.when(stratum(m) == s, F.lit(float(c))).otherwise(out)
    return out


def kept(m: str, chosen: dict) -> Column:
    return ~base_failed(m) & F.coalesce(score(m) < cutoff(m, chosen), F.lit(True))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Rows are staged with their measures, so each text is measured once."""
    measured = staged(docs.select(F.struct("*").alias("__row"), F.col(key).alias("__key"), measures(text).alias("__m")), "measured")
    chosen = fit(measured.select(F.col("__key").alias(key), F.col("__m").alias("m")), labels, key=key)
    return measured.filter(kept("__m", chosen)).select("__row.*")

"""Language identification by interpolated Kneser-Ney character models.

Words are runs of letters, lower case, padded with ORDER - 1 start marks and an end
mark.  Per language, n-grams of ORDER characters are counted; lower orders use
continuation counts (number of different characters seen before the n-gram).
Each order subtracts its own absolute discount and hands what it saved to the
next lower order, down to a uniform distribution over the characters known
and one unknown.  The models are two sorted arrays of 64-bit n-gram hashes per order,
one with the discounted probabilities, one with the weights of the lower order, with
one value per language; look-ups are binary searches.

A text's language is the one with the lowest cross-entropy per character over
all its words; ties go to the name first in code point order.  Two things are
calibrated on training documents kept out of the counts: a scale that makes
``score`` (the softmax of the negative cross-entropies) fit the share of right
answers, and for each language the cross-entropy that REJECT of its documents exceed.
A text above it is flagged ``rejected`` (it keeps its best language).

Training reads at most about TRAIN_DOCS documents of each language for the counts and
CHECK_DOCS for the calibration, chosen by a hash of their ids; these are the documented
bounds of the fit.  Only they bound the model; every language is learned and every text is scored whole.
A language that only has documents kept out for the calibration is counted from these and not calibrated.

Null texts and texts without a letter are ``und`` with score 0, and so is everything
if there is nothing to learn from.  Rows with null language or null id are not
learned from.
"""

from __future__ import annotations

import sys
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEX_RANGE, hex_number
from .dartminhash import mix
from .worker import keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 5
TRAIN_DOCS, CHECK_DOCS = 1_500, 300
REJECT = 0.005
START, END = "\x02", "\x03"
#: Words that a worker keeps the scores of.
WORDS = 300_000
SCALES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)


def remainder(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5))


# -- training -------------------------------------------------------------------

def _bounded(docs: DataFrame, key: str, lang: str, most: int) -> DataFrame:
    """About ``most`` documents of each language, chosen by a hash of the id.

    The table of languages (their models reach the driver anyway) is broadcast: documents are never shuffled by language."""
    counts = docs.groupBy(F.col(lang).alias("__lang")).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select("__lang", (F.lit(float(most)) / F.col("__n")).alias("__part"))
    place = hex_number(F.md5(F.concat(F.lit("train:"), F.col(key).cast("string")))) / F.lit(float(HEX_RANGE))
    return docs.join(F.broadcast(counts), F.col(lang) == F.col("__lang")).filter(place < F.col("__part"))


def gram_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = TRAIN_DOCS) -> dict:
    """{language: {n-gram of ORDER characters: count}} of a bounded sample; only distinct n-grams reach the driver."""
    some = _bounded(docs.select(key, text, lang), key, lang, most)
    words = some.select(F.col(lang).alias("lang"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counted = words.groupBy("lang", "word").count()
    padded = F.concat(F.lit(START * (ORDER - 1)), F.col("word"), F.lit(END))
    grams = counted.select("lang", "count", padded.alias("p")).select(
        "lang", "count", F.explode(F.expr(f"transform(sequence(1, length(p) - {ORDER - 1}), i -> substring(p, i, {ORDER}))")).alias("gram"))
    out: dict = defaultdict(dict)
    for row in grams.groupBy("lang", "gram").agg(F.sum("count").alias("n")).toLocalIterator():
        out[row["lang"]][row["gram"]] = row["n"]
    return dict(out)


def gram_hash(codes: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the ``order`` characters up to each place; places before ``order`` - 1 are meaningless."""
    out = np.full(len(codes), np.uint64(order))
    for back in range(order - 1, -1, -1):
        out = mix(out ^ np.concatenate([np.zeros(back, np.uint64), codes[:len(codes) - back]]))
    return out


def _hash_of(grams: list, order: int) -> np.ndarray:
    codes = np.array([[ord(c) for c in g] for g in grams], np.uint64).reshape(len(grams), order)
    out = np.full(len(grams), np.uint64(order))
    for i in range(order):
        out = mix(out ^ codes[:, i])
    return out


def _sorted(keys: np.ndarray, values: list) -> tuple:
    order = np.argsort(keys)
    return keys[order], np.array(values, float)[order]


def kneser_ney(counts: dict, characters: int) -> list:
    """Per order 1 to ORDER: (hashes, discounted probabilities) and (context hashes, lower weights)."""
    tables, now = {ORDER: counts}, counts
    for order in range(ORDER - 1, 0, -1):
        now = Counter(g[1:] for g in now)  # continuation counts: different n-grams with this ending
        tables[order] = now
    model = []
    for order in range(1, ORDER + 1):
        table = tables[order]
        ones, twos = sum(1 for v in table.values() if v == 1), sum(1 for v in table.values() if v == 2)
        discount = ones / (ones + 2 * twos) if ones and twos else 0.75
        total, kinds = Counter(), Counter()
        for g, v in table.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        grams, contexts = list(table), list(total)
        part = _sorted(_hash_of(grams, order), [max(table[g] - discount, 0.0) / total[g[:-1]] for g in grams])
        rest = _sorted(_hash_of(contexts, order - 1), [min(discount, 1.0) * kinds[c] / total[c] for c in contexts])
        model.append((part, rest))
    return [characters, model]


def merged(tables: list, missing: float) -> tuple:
    """One sorted hash array for all languages and a row of values for each hash; the last row is for unknown ones."""
    keys = np.unique(np.concatenate([k for k, _ in tables]))
    values = np.full((len(keys) + 1, len(tables)), missing)
    for m, (k, v) in enumerate(tables):
        values[np.searchsorted(keys, k), m] = v
    return keys, values


def find(table: tuple, wanted: np.ndarray) -> np.ndarray:
    """The values of each wanted hash, by binary search."""
    known, values = table
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return values[np.where(known[at] == wanted, at, len(known))]


class Models:
    """Cross-entropies of texts under the models of all languages."""

    def __init__(self, models: dict):
        self.names = sorted(models)
        all_models = [models[n] for n in self.names]
        self.characters = all_models[0][0] if all_models else 1
        self.orders = [(merged([m[1][k][0] for m in all_models], 0.0), merged([m[1][k][1] for m in all_models], 1.0))
                       for k in range(ORDER)] if all_models else []
        self.letters = regex.compile(r"\p{L}+").findall
        self.restart()

    def restart(self):
        self.words, self.runs, self.used = {}, {}, 0
        self.scores = np.zeros((1024, len(self.names) + 1))

    def add(self, rows: np.ndarray) -> int:
        """Appends rows of scores, returns the place of the first."""
        first, self.used = self.used, self.used + len(rows)
        if self.used > len(self.scores):
            more = np.zeros((max(self.used, 2 * len(self.scores)) - len(self.scores), self.scores.shape[1]))
            self.scores = np.concatenate([self.scores, more])
        self.scores[first:self.used] = rows
        return first

    def run_scores(self, runs: list) -> np.ndarray:
        """Per run of letters: total cost (nats) under each model, and the number of characters predicted."""
        codes = np.frombuffer("".join(START * (ORDER - 1) + r + END for r in runs).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        lengths = np.array([len(r) + 1 for r in runs])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        places = np.arange(lengths.sum()) + np.repeat((np.arange(len(runs)) + 1) * (ORDER - 1), lengths)
        p = np.full((len(places), len(self.names)), 1.0 / self.characters)
        for order, (part, rest) in enumerate(self.orders, 1):
            p = find(part, gram_hash(codes, order)[places]) + find(rest, gram_hash(codes, order - 1)[places - 1]) * p
        return np.column_stack([np.add.reduceat(-np.log(p), starts, axis=0), lengths])

    def learn(self, words: list) -> None:
        """Scores of words not met before; most are one run of letters, whose scores they share."""
        found = [(w, self.letters(w.lower())) for w in words]
        new = list({r for _, runs in found for r in runs}.difference(self.runs))
        for at in range(0, len(new), 5000):
            part = new[at:at + 5000]
            first = self.add(self.run_scores(part))
            self.runs.update(zip(part, range(first, first + len(part))))
        for w, runs in found:
            places = [self.runs[r] for r in runs]
            self.words[w] = places[0] if len(places) == 1 else self.add(self.scores[places].sum(axis=0, keepdims=True))

    def entropies(self, texts: list) -> np.ndarray:
        """Per text: cross-entropy per character under each model, and the number of characters."""
        split = [(t or "").split() for t in texts]
        if len(self.words) > WORDS:
            self.restart()
        self.learn(list(set().union(*split).difference(self.words)))
        out = np.zeros((len(texts), len(self.names) + 1))
        for i, words in enumerate(split):
            if words:
                out[i] = self.scores[np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))].sum(axis=0)
        out[:, :-1] /= np.maximum(out[:, -1:], 1)
        return out


def softmax(entropies: np.ndarray, scale: float) -> np.ndarray:
    e = np.exp(-scale * (entropies - entropies.min(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def calibrate(models: Models, texts: list, langs: list) -> tuple:
    """(scale of the score, {language: highest cross-entropy accepted})."""
    scale, limits = 16.0, {}
    if texts:
        h = models.entropies(texts)
        right = np.array([models.names.index(x) for x in langs])
        use = h[:, -1] > 0
        h, right = h[use, :-1], right[use]
        if len(right):
            loss = lambda s: -np.log(np.maximum(softmax(h, s)[np.arange(len(right)), right], 1e-9)).sum()
            scale = min(SCALES, key=loss)
            for i, name in enumerate(models.names):
                own = h[(right == i) & (h.argmin(axis=1) == i), i]
                if len(own):
                    limits[name] = float(np.quantile(own, 1 - REJECT))
    return scale, limits


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS,
        check_docs: int = CHECK_DOCS) -> tuple:
    """(models by language, scale, limits) from the labelled documents that are not held out."""
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (remainder(key) != 0)).select(key, text, lang)
    counts = gram_counts(usable.filter(remainder(key) != 4), key, text, lang, train_docs)
    aside, learned = usable.filter(remainder(key) == 4), set(counts)
    rare = sorted({r[0] for r in aside.select(lang).distinct().collect()} - learned)
    if rare:
        counts |= gram_counts(aside.filter(F.col(lang).isin(rare)), key, text, lang, train_docs)
    characters = len({c for grams in counts.values() for g in grams for c in g}) + 1
    models = {name: kneser_ney(grams, characters) for name, grams in counts.items()}
    texts, langs = [], []
    if models:
        for row in _bounded(aside, key, lang, check_docs).select(text, lang).toLocalIterator():
            if row[1] in learned:
                texts.append(row[0])
                langs.append(row[1])
    scale, limits = calibrate(Models(models), texts, langs) if models else (1.0, {})
    return models, scale, limits


def predict(docs: DataFrame, fitted: tuple, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred, score, cross_entropy, rejected, one row per input row."""
    shared, version = docs.sparkSession.sparkContext.broadcast(fitted), uuid.uuid4().hex

    def run(texts: pa.Array) -> pa.Array:
        models, scale, limits = shared.value
        scorer = keep(("langid", version), lambda: Models(models))
        names, scores, costs, rejected, rows = [], [], [], [], texts.to_pylist()
        for at in range(0, len(rows), 500):
            h = scorer.entropies(rows[at:at + 500])
            if not models:
                best, p, low = [None] * len(h), np.zeros(len(h)), np.zeros(len(h))
            else:
                best, p, low = h[:, :-1].argmin(axis=1), softmax(h[:, :-1], scale).max(axis=1), h[:, :-1].min(axis=1)
            for i in range(len(h)):
                some = models and h[i, -1] > 0
                names.append(scorer.names[best[i]] if some else "und")
                scores.append(float(p[i]) if some else 0.0)
                costs.append(float(low[i]) if some else None)
                rejected.append(bool(some and low[i] > limits.get(names[-1], np.inf)))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(costs, pa.float64()),
                                           pa.array(rejected, pa.bool_())], ["lang_pred", "score", "cross_entropy", "rejected"])

    kind = "struct<lang_pred:string,score:double,cross_entropy:double,rejected:boolean>"
    out = docs.select(F.col(key).alias("__key"), F.arrow_udf(run, kind)(F.col(text)).alias("__p"))
    return out.select(F.col("__key").alias(key), F.coalesce(remainder("__key") == 0, F.lit(False)).alias("held_out"), "__p.*")

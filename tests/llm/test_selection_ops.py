import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, awkward_rows, empty, words
from pyspark.sql import functions as F

from tablewright.llm import bytebpe, collocations, importance, tokenfile, topk, worker


# -- importance resampling --------------------------------------------------------

def brute_resample(rows, target, percent, least=importance.MIN_WORDS):
    cut = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    bucket = lambda w: zlib.crc32(w) % 10000
    own = collections.Counter(bucket(w) for _, t in rows for w in cut(t))
    goal = collections.Counter(bucket(w) for t in target for w in cut(t))
    n, m = sum(own.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1.0) * (n + 10000) / ((own[b] + 1.0) * (m + 10000))))
    out = []
    for i, t in rows:
        ws = cut(t)
        weight = sum(gain(bucket(w)) for w in ws) // len(ws) if ws else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(ws), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[:percent * len(able) // 100]
    return out, [(r[0], r[3], k + 1) for k, r in enumerate(drawn)]


@pytest.mark.parametrize("percent", [0, 1, 10, 55, 100])
def test_resampling_against_brute_force(spark, percent):
    r = random.Random(5)
    rows = [(i % 290, words(r.randint(0, 60), r.randint(0, 40))) for i in range(400)]
    rows += [(i, t) for i, t, *_ in awkward_rows()]
    target = [words(50, s) for s in range(3)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("row", F.lit(1)).repartition(5)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent).collect()
    every, drawn = brute_resample(rows, target, percent)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(g)[:4] for g in got), key=key) == sorted(every, key=key)
    assert sorted(((g.doc_id, g.score, g["rank"]) for g in got if g["rank"] is not None), key=lambda x: x[2]) == drawn


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(empty(spark), none).count() == 0
    got = importance.resample(awkward(spark), none).collect()
    assert len(got) == len(awkward_rows()) and all(g.n_features >= 0 for g in got)


def test_the_bracket_widens_until_it_holds_the_cutoff(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 990, 7).otherwise(F.col("id")).cast("long").alias("score"),
                                    F.col("id").alias("row"))
    for take in (1, 5, 10, 11, 500, 1000):
        low, high, above = importance.bracket(rows, take, 1000)
        inside = rows.filter(F.col("score").between(low, high)).count()
        assert above < take <= above + inside
    assert tuple(importance.cutoff(rows, 10, 1000)) == (990, 990, 990) and tuple(importance.cutoff(rows, 13, 1000)) == (7, 2, 2)


# -- top-k ---------------------------------------------------------------------------

def brute_topk(rows, k):
    good = [(n, i, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in good:
        if i is not None and i % 50 == 0:
            found = sorted(((-sum(a * b for a, b in zip(q, v)), j is None, j or 0, m) for m, j, v in good if m != n))[:k]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j, _) in enumerate(found)]
    return sorted(out, key=lambda x: tuple((v is None, v) for v in x))


@pytest.mark.parametrize("size,dims,blocks", [(300, 8, 1 << 20), (300, 8, 512), (40, 3, 64), (7, 2, 4)])
def test_topk_against_brute_force(spark, monkeypatch, size, dims, blocks):
    monkeypatch.setattr(topk, "CANDIDATE_VALUES", blocks)
    monkeypatch.setattr(topk, "QUERY_VALUES", 64)
    r = random.Random(size + blocks)
    rows = [(25 * i, [r.gauss(0, 0.3) for _ in range(dims)]) for i in range(size)]
    rows += [(100, rows[2][1]), (None, [1.0] * dims), (50, None), (150, [None] * dims), (200, [float("nan")] * dims), (250, [float("inf")] * dims),
             (350, []), (400, [0.0] * dims), (450, [2.0] * (dims + 3)), (500, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit(0)).withColumn("id", F.lit("x")).repartition(4)
    got = [tuple(g) for g in topk.top_k(df, F.col("id") % 50 == 0).collect()]
    assert sorted(got, key=lambda x: tuple((v is None, v) for v in x)) == brute_topk(rows, 5)


def test_topk_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("id") % 50 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema), F.col("id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, []), (1, [])], schema)
    assert [tuple(r) for r in topk.top_k(two, F.col("id") % 50 == 0).collect()] == [(0, 1, 1, 0)]
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(200)], schema)
    got = topk.top_k(same, F.col("id") == 50).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 128 * 128 + 64 * 64) for i in range(5)]


def test_processing_stops_early_with_proof():
    r = np.random.default_rng(3)
    values = np.floor(32 * r.standard_normal((4000, 32))).astype(np.int64)
    table = pa.table({"v": pa.array(values.tolist(), pa.list_(pa.int64())), "id": pa.array(range(4000), pa.int64()), "row": pa.array(range(4000), pa.int64())})
    block = topk.Block(topk.index_block((pa.scalar(0),), table))
    touched = []
    plain = np.bincount
    for q in range(20):
        count = [0]

        def seen(x, *a, **k):
            count[0] += len(x) if not a else 0
            return plain(x, *a, **k)
        topk.np.bincount = seen
        try:
            at, scores = block.search(values[q], q, 5)
        finally:
            topk.np.bincount = plain
        exact = values @ values[q]
        exact[q] = -10 ** 12
        want = np.lexsort((np.arange(4000), -exact))[:5]
        assert at.tolist() == want.tolist() and scores.tolist() == exact[want].tolist()
        touched.append(count[0] / values.size)
    assert np.mean(touched) < 0.8


# -- collocations ------------------------------------------------------------------------

def brute_collocations(rows, least, top):
    count, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for n in range(1, 5):
                for i in range(len(ws) - n + 1):
                    count[lang, tuple(ws[i:i + n])] += 1
    found = {}
    for (lang, p), a in count.items():
        if len(p) > 1 and a >= least:
            cuts = [(2000000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (a, count[lang, p[:k]], count[lang, p[k:]], score)
    gone = set()
    for (lang, p), (a, *_) in found.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                if 100 * a >= 80 * found[lang, p[i:i + n]][0]:
                    gone.add((lang, p[i:i + n]))
    out = []
    for of in {k[0] for k in found}:
        left = sorted(((-v[3], -v[0], " ".join(p).encode(), v) for (lang, p), v in found.items() if lang == of and (lang, p) not in gone))
        out += [(of, r + 1, p.decode(), v[0], v[1], v[2], total[of], v[3]) for r, (_, _, p, v) in enumerate(left[:top])]
    return sorted(out)


def prose(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "ß", "漢字", "It's", "\x01x"]
    return "".join(r.choice(vocabulary[:r.randint(1, len(vocabulary))]) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!? ", "\r\n"]) for _ in range(n))


@pytest.mark.parametrize("shard,size,bits,top", [(6 << 20, 600_000, 1 << 27, 2000), (700, 40, 1 << 12, 7)])
def test_collocations_against_brute_force(spark, monkeypatch, shard, size, bits, top):
    for name, value in (("SHARD", shard), ("RANGE", size), ("TABLE_BITS", bits)):
        monkeypatch.setattr(collocations, name, value)
    rows = [(lang, prose(i, 300)) for i, lang in enumerate(["en", "de", None, "en", "en", "und"] * 5)]
    rows += [("en", None), ("en", ""), ("xx", "one two three"), ("en", "a b c " * 200), ("de", "x y. " * 100), ("de", " ... ")]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("words", F.lit(1)).withColumn("a", F.lit("x")).repartition(3)
    got = collocations.collocations(df, least=30, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 30, top)


def test_collocations_of_awkward_tables(spark):
    assert collocations.collocations(empty(spark)).count() == 0
    rows = [(lang, t) for _, t, lang, *_ in awkward_rows()]
    assert sorted(map(tuple, collocations.collocations(awkward(spark)).collect())) == brute_collocations(rows, 30, 2000)


def test_best_rows_deals_out_large_groups(spark):
    rows = spark.range(5000).select(F.lit("g").alias("lang"), (F.col("id") * 7919 % 5000).alias("score"), F.col("id").cast("string").alias("phrase"))
    best = collocations.best_rows(rows, "lang", [F.col("score").desc()], "phrase", 10, 5000)
    assert sorted((r["rank"], r.score) for r in best.collect()) == [(i + 1, 4999 - i) for i in range(10)]


def test_scores_beyond_64_bits():
    p = collocations.Phrases([b"a", b"b"], np.array([[1], [2]]), np.array([6 * 10 ** 18]))
    parts, refs = collocations.parts_of(p)
    rows = collocations.score_rows(p, np.array([6 * 10 ** 18, 9 * 10 ** 18]), refs)
    assert rows == [("a b", 2, 6 * 10 ** 18, 6 * 10 ** 18, 9 * 10 ** 18, 800000)]


def test_transducers_round_trip_and_compose():
    r = random.Random(2)
    table = collections.Counter()
    for _ in range(500):
        table[tuple(r.choice([b"a", b"b", b"c d"[:1], b"e", b"\xc3\xa9"]) for _ in range(r.randint(1, 4)))] += r.randint(1, 300)
    vocabulary = sorted({w for p in table for w in p})
    cols = np.array([[vocabulary.index(w) + 1 for w in p] + [0] * (4 - len(p)) for p in table]).T
    p = collocations.summed(vocabulary, cols, np.array(list(table.values())))
    back = collocations.Transducer(collocations.transducer(p)).phrases()
    assert dict(zip(back.tuples(), back.counts.tolist())) == dict(table) and back.tuples() == sorted(table)
    wanted = sorted({*list(table)[::3], (b"zz",), (b"a", b"zz"), (b"a", b"b", b"e", b"e")})
    words_of = sorted({w for q in wanted for w in q})
    ask = collocations.summed(words_of, np.array([[words_of.index(w) + 1 for w in q] + [0] * (4 - len(q)) for q in wanted]).T, np.ones(len(wanted), np.int64))
    assert collocations.Transducer(collocations.transducer(p)).compose(ask).tolist() == [table[q] for q in ask.tuples()]
    half = [collocations.Phrases(p.words, p.cols[:, i::2], p.counts[i::2]) for i in (0, 1)]
    both = collocations.union([*half, half[0]])
    assert dict(zip(both.tuples(), both.counts.tolist())) == {q: n + (n if i % 2 == 0 else 0) for i, (q, n) in enumerate(zip(p.tuples(), p.counts.tolist()))}


# -- what workers keep --------------------------------------------------------------------

def test_memos_stay_small_and_keep_frequent_keys():
    calls = collections.Counter()

    def compute(key):
        calls[key] += 1
        return key + "!"
    memo = worker.Memo(compute, 100 * worker.Memo.ENTRY)
    for i in range(5000):
        assert memo["often"] == "often!" and memo[f"k{i}"] == f"k{i}!"
    assert calls["often"] == 1 and len(memo) <= 50 and len(memo.older) <= 50
    assert memo["x" * 1000] == "x" * 1000 + "!" and "x" * 1000 not in memo
    assert memo.many(["often", "new", "y" * 500], lambda new: {k: k + "?" for k in new}) == ["often!", "new?", "y" * 500 + "?"]


def test_texts_are_cut_by_size():
    texts = pa.array(["a" * 10, None, "b" * 1000, "", "c" * 10, "d"])
    assert [s.to_pylist() for s in worker.slices(texts, 20)] == [["a" * 10, None], ["b" * 1000, ""][:1], ["", "c" * 10, "d"]]
    assert [list(s) for s in worker.slices(pa.array([], pa.string()), 5)] == []


def test_many_texts_encode_like_one(spark):
    coder, encoder = bytebpe.coder(), tokenfile.WordEncoder(tokenfile.VOCABULARY)
    texts = ["", " ", "a b", "a  b", "\na b\n", "x\n y", " lead", "trail ", "one", "é ü\tö", "<|endoftext|> A B", "<|ENDOFTEXT|> a", "don't, stop. Now!"]
    ids, ends = coder.encode_all(pa.array(texts))
    for t, a, b in zip(texts, [0, *ends[:-1]], ends):
        part = coder.encode_part(t)
        assert ids[a:b].astype("<u4").tobytes() == part and coder.decode(part) == t.encode()
    for t, part in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(part, "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids

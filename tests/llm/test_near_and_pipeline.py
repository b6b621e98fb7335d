import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import awkward, awkward_rows, empty, words
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import bytebpe, dartminhash, exact_dedup, mixing, quality
from tablewright.llm.common import staged

SF = "/root/testdata/sf0.001"


def brute_classes(texts):
    """{index: smallest index of its class} by comparing all pairs."""
    sets = [dartminhash.weighted_shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i][0]) and dartminhash.similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in range(len(texts))}


def test_signature_agreement_is_similarity():
    r = random.Random(1)
    e = np.array([r.getrandbits(63) for _ in range(60)], np.uint64)
    weigh = lambda n: np.array([r.choice([1, 1, 2, 5, 9]) for _ in range(n)])
    x, y = (np.sort(e[:45]), weigh(45)), (np.sort(e[10:]), weigh(50))
    both = dartminhash.signatures([x, y, x], 4096)
    assert abs((both[0] == both[1]).mean() - dartminhash.similarity(x, y)) < 0.04
    assert (both[0] == both[2]).all()
    tiny = (np.array([5], np.uint64), np.array([1]))
    assert (dartminhash.signatures([tiny, x], 64)[1] == dartminhash.signatures([x], 64)[0]).all()


def test_similarity_by_counting():
    from collections import Counter
    a, b = "a b c d e f g a b c d e f", "a b c d e f h a b c d e f"
    def bag(t):
        w = t.split()
        return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    x, y = bag(a), bag(b)
    want = sum((x & y).values()) / sum((x | y).values())
    assert dartminhash.similarity(dartminhash.weighted_shingles(a), dartminhash.weighted_shingles(b)) == pytest.approx(want)


def changed(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10 ** 6)}"
    return " ".join(w)


def test_near_classes_by_brute_force(spark):
    texts = []
    for g in range(12):
        base = words(150, g)
        texts += [changed(base, n, g * 100 + n) for n in range(6)] + [base]
    texts += [changed(words(200, 99), 4, s) for s in range(60)]  # one large group, far from a clique
    texts += [words(60, 500 + s) + " " + words(40, 77) for s in range(30)]  # a shared passage
    texts += ["a b c", "a b c", "a b", "x y z w v"]
    want = brute_classes(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in dartminhash.near_duplicates(docs).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    kept = defaultdict(int)
    for r in got.values():
        kept[r.class_id] += r.kept
    assert set(kept.values()) == {1} and all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_buckets_go_on_until_settled(spark):
    """Pairs that the first pivot can't link are found by later pivots, small buckets, or the full comparison."""
    base = words(120, 7).split()
    texts = [" ".join(base[i * 3:i * 3 + 60]) for i in range(20)]  # a chain: only neighbours are similar
    rows = [(i, t) for i, t in enumerate(texts)]
    want = brute_classes(texts)
    assert len(set(want.values())) == 1
    members = spark.createDataFrame([(1, i) for i, _ in rows], "bucket long, node long")
    nodes = spark.createDataFrame(rows, "node long, text string").withColumn("profile", dartminhash.profile("text"))
    for small, pivots in ((64, 3), (2, 2), (2, 0)):
        _, labels = dartminhash.near_links(members, nodes, small=small, pivots=pivots)
        assert {r.node: r.label for r in labels.collect()} == want


def test_blocks_keep_pairs_at_the_threshold(spark):
    """28 of 35 shingles are exactly 0.8; in doubles 28 * 1.8 < 63 * 0.8."""
    long = [f"w{i}" for i in range(39)]
    texts = [words(40, 900 + i) for i in range(18)] + [" ".join(long[:32]), " ".join(long)]
    want = brute_classes(texts)
    assert want[18] == want[19] == 18 and len(set(want.values())) == 19
    members = spark.createDataFrame([(1, i) for i in range(len(texts))], "bucket long, node long")
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string").withColumn("profile", dartminhash.profile("text"))
    links, _ = dartminhash.near_links(members, nodes, pivots=0)
    assert [tuple(r) for r in links.collect()] == [(18, 19)]


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 105), (100, 105)] + [(200, 200 + k) for k in range(1, 50)]
    got = {r.node: r.label for r in dartminhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[105] == 100 and all(got[200 + k] == 200 for k in range(50))


def test_near_edges(spark):
    docs = awkward(spark)
    rows = dartminhash.near_duplicates(docs).collect()
    assert len(rows) == len(awkward_rows())
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.class_id, r.class_size, r.kept))
    assert {c[0] for c in by[3] | by[2] | by[15]} == {1} and by[4] == {(4, 1, True)}
    kept = dartminhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in rows)
    assert dartminhash.near_duplicates(empty(spark)).count() == 0 and dartminhash.keep_one(empty(spark)).count() == 0


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    columns, tables = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "test-pipeline")
        tables.append(docs)
    rules, exact, near, mixed, coded = [t.collect() for t in tables]
    assert all(t.columns == columns for t in tables[:4])
    # rules: base rules by hand; cutoffs only where certified
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    chosen = quality.fit(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", quality.measures().alias("m")), labels)
    base_ok = set()
    for i, t in before.items():
        m = dict(zip(quality.MEASURES, quality.measure(t)))
        if m["n_words"] >= 50 and 100 * m["n_repeat_words"] <= 50 * m["n_words"]:
            base_ok.add(i)
    assert {r.doc_id for r in rules} <= base_ok and (chosen or {r.doc_id for r in rules} == base_ok)
    # exact: largest id of each text
    best = defaultdict(int)
    for r in rules:
        best[r.text] = max(best[r.text], r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(best.values())
    # near: smallest id of each class
    ordered = sorted(exact, key=lambda r: r.doc_id)
    classes = brute_classes([r.text for r in ordered])
    assert sorted(r.doc_id for r in near) == sorted(ordered[i].doc_id for i in set(classes.values()))
    # mix: one row per pass
    plan = mixing.plan_mix(tables[2]).select("doc_id", F.size("passes").alias("n")).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(p.doc_id for p in plan for _ in range(p.n))
    # tokens: decode to the texts
    coder = bytebpe.coder()
    for r in coded:
        assert coder.decode(np.array(r.ids, "<u4").tobytes()).decode() == before[r.doc_id]
    assert sorted(r.doc_id for r in coded) == sorted(r.doc_id for r in mixed)


def test_pipeline_stages_on_awkward_and_empty_tables(spark, scratch):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    for docs in (awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = staged(stage(spark, docs, scratch), "test-stage")
            assert out.columns == docs.columns and out.count() <= 2 * docs.count()
        assert corpus_pipeline.encode(spark, docs, scratch).count() == docs.count()


def test_keep_rules_agree(spark):
    """The operators' row filters keep what their reports say."""
    docs = awkward(spark)
    report = exact_dedup.dedup_report(docs).filter("kept").count()
    assert exact_dedup.drop_duplicates(docs).count() == report

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from helpers import awkward, awkward_rows, empty
from pyspark.sql import functions as F

from tablewright.llm import common, exact_dedup, mixing, rendezvous
from tablewright.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("keep,fan", [("largest", 16), ("smallest", 2)])
def test_dedup_report(spark, keep, fan):
    got = exact_dedup.dedup_report(awkward(spark), keep=keep, rows_per_run=2, fan=fan).collect()
    groups = defaultdict(list)
    for i, t, *_ in awkward_rows():
        groups[t or ""].append(i)
    assert len(got) == len(awkward_rows())
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in got:
        ids = by_digest[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == ((max if keep == "largest" else min)(known) if known else None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_dedup_rows_keep_all_columns(spark):
    docs = awkward(spark)
    out = exact_dedup.drop_duplicates(docs, rows_per_run=3, fan=2)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len({t or "" for _, t, *_ in awkward_rows()})
    assert len({r.text or "" for r in rows}) == len(rows)
    assert {r.doc_id for r in rows if (r.text or "") == ""} == {5}


def test_dedup_rounds_grow():
    assert [exact_dedup.rounds_for(n, 10, 4) for n in (0, 40, 41, 160, 161)] == [1, 1, 2, 2, 3]


def test_empty_tables(spark):
    e = empty(spark)
    assert exact_dedup.dedup_report(e).count() == 0
    assert exact_dedup.drop_duplicates(e).count() == 0
    assert rendezvous.with_slots(rendezvous.assign(e, [1.0, 2.0], [1.0, 2.0, 1.0])).count() == 0
    assert mixing.plan_mix(e).count() == 0
    assert mixing.curriculum(e).count() == 0


def _brute_shard(key, n):
    u = lambda i: int(hashlib.md5(f"{'null' if key is None else key}:{i}".encode()).hexdigest()[:13], 16)
    return max(range(n), key=lambda i: (u(i), -i))


def test_shards_by_brute_force(spark):
    import zlib
    rows = rendezvous.with_slots(rendezvous.assign(awkward(spark), [1.0] * 4, [1.0] * 5)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in awkward_rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r.shard == _brute_shard(r.doc_id, 4) and r.grown_shard == _brute_shard(r.doc_id, 5)
        assert r.grown_shard in (r.shard, 4)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_query_is_whole_and_near_even(spark):
    rows = QUERIES["op10_rendezvous_shards"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert {r.shard for r in rows} <= set(range(16)) and all(r.grown_shard in (r.shard, 16) for r in rows)


def test_weighted_shards(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    counts = dict(ids.groupBy(rendezvous.shard_of("doc_id", [1.0, 3.0])).count().collect())
    assert abs(counts[1] / 20_000 - 0.75) < 0.02


def test_written_shards(spark, scratch):
    docs = awkward(spark)
    rendezvous.write_shards(docs, f"{scratch}/shards", [1.0] * 4)
    assert spark.read.parquet(f"{scratch}/shards").count() == docs.count()


def test_running_total_over_many_buckets(spark):
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 2).alias("g"), F.lit(2).alias("v"),
                                    F.pmod(F.xxhash64("id"), F.lit(common.HEX_RANGE)).alias("place"))
    got = common.running_total(rows, "g", "place", ["id"], "v", "before", 50).collect()
    for g in (0, 1):
        order = sorted((r for r in got if r.g == g), key=lambda r: (r.place, r.id))
        assert [r.before for r in order] == [2 * i for i in range(len(order))]


def test_running_total_cuts_rows_of_one_place(spark):
    """A third of the rows have one id: their rows go to many buckets, in the order of the other columns."""
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("id"), F.lit(2).alias("v"),
                                    F.when(F.col("id") % 9 != 0, F.pmod(F.hash("id"), F.lit(100))).alias("size"))
    rows = common.staged(rows.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(common.HEX_RANGE))), "one-place")
    dealt = common.dealt_buckets(rows, "g", "place", ["id", "size"], 30, most=200)
    assert max(r["count"] for r in dealt.groupBy("g", "__bucket").count().collect()) <= 250
    out = common.running_total(rows, "g", "place", ["id", "size"], "v", "before", 30, most=200)
    assert out.columns == [*rows.columns, "before"]
    last = lambda x: (x is None, x or 0)
    for g in (0, 1):
        order = sorted((r for r in out.collect() if r.g == g), key=lambda r: r.before)
        assert [r.before for r in order] == [2 * i for i in range(1500)]
        keys = [(r.place, last(r.id), last(r["size"])) for r in order]
        assert keys == sorted(keys)


def _water(sizes, weights, volume):
    total, caps, open_, target = volume * sum(sizes), [2 * s for s in sizes], set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        level = (total - sum(caps[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * level > caps[i]}
        if not over:
            for i in open_:
                target[i] = weights[i] * level
            return target
        for i in over:
            target[i] = float(caps[i])
        open_ -= over
    return target


def test_mix_targets_and_taken(spark):
    rows = mixing.plan_mix(awkward(spark)).collect()
    sizes = defaultdict(int)
    for _, t, _, s, *_ in awkward_rows():
        sizes[s] += len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, _water([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5)))
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    taken = defaultdict(int)
    for r in rows:
        assert any(r.source_size == sizes[s] and r.target == pytest.approx(targets[s]) for s in order)
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(p.taken for p in r.passes)
        assert all(0 <= p.position <= 1 for p in r.passes)
        taken[(r.source_size, round(r.target, 6))] += r.taken
    assert all(abs(n - k[1]) <= 1 for k, n in taken.items() if k[0])
    again = mixing.plan_mix(awkward(spark).repartition(5)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in rows) == Counter((r.doc_id, r.size, r.taken) for r in again)


@pytest.mark.parametrize("rates", [*mixing.SCHEDULES, (0.0, 1.0, 0.0)])
def test_schedule_inversion(spark, rates):
    shares = [i / 200 for i in range(201)]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.invert_schedule(F.col("s"), rates)).collect()]
    assert got == sorted(got)

    def integral(t):
        out = 0.0
        for a, b, r, s in zip(mixing.KNOTS, mixing.KNOTS[1:], rates, rates[1:]):
            x = min(max(t - a, 0), b - a)
            out += r * x + (s - r) * x * x / (2 * (b - a))
        return out
    for s, t in zip(shares, got):
        assert math.isclose(integral(t) / integral(1.0), s, abs_tol=1e-9)


def test_curriculum_is_sorted_and_keeps_rows(spark):
    docs = awkward(spark)
    out = mixing.curriculum(docs)
    assert out.columns == docs.columns
    plan = {(r.doc_id, r.size): len(r.passes) for r in mixing.plan_mix(docs).collect()}
    got = Counter((r.doc_id, len((r.text or "").encode().split())) for r in out.collect())
    assert all(got[k] % max(n, 1) == 0 for k, n in plan.items()) and sum(got.values()) >= len([n for n in plan.values() if n])


def test_no_python_in_native_plans(spark):
    for name in ("op4_curriculum_mix", "op8_tree_merge_dedup", "op6_randomness_secrets"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoop"))


def test_oracles(spark):
    import duckdb
    con = duckdb.connect()
    for table in ("documents", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    for name, sql in ORACLE_SQL.items():
        res = con.execute(sql)
        names = [c[0] for c in res.description]
        near = lambda v: round(v, 6) if isinstance(v, float) else v
        want = sorted(map(repr, (tuple(near(v) for v in r) for r in res.fetchall())))
        df = QUERIES[name](spark, SF)
        got = sorted(map(repr, (tuple(near(v) for v in r) for r in df.select(*names).collect())))
        assert got == want


def test_rounds_merge_sorted_runs(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "cast(id % 700 as string) as text")
    for keep in ("largest", "smallest"):
        got = exact_dedup.dedup_report(docs, keep=keep, rows_per_run=40, fan=4).collect()
        best = {}
        for i in range(3000):
            best.setdefault(i % 700, []).append(i)
        pick = max if keep == "largest" else min
        assert len(got) == 3000 and all(r.keep_id == pick(best[r.doc_id % 700]) and r.group_size == len(best[r.doc_id % 700]) for r in got)
    rows = common.staged(exact_dedup.digest_rows(docs), "t")
    dealt, levels = exact_dedup.merge_runs(rows, rows_per_run=40, fan=4)
    assert len(levels) == 5 and levels[-1].count() == 700 and levels[-1].select("run").distinct().count() == 1
    plan = exact_dedup.merged(levels[0], 1, 256)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Window" in plan

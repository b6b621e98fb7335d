"""Queries of the subpackage over the TESTDATA tables and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (bytebpe, collocations, dartminhash, editcount, exact_dedup, importance, langid, mixing, quality, randomness, rendezvous,
               tokenfile, topk)
from .common import documents, stage_path, staged

SHARDS = 16


def op1_orc_tokens(spark, sf_dir):
    """Token ids of every document written as indexed ORC, and start, count and crc32 read back from it."""
    path = stage_path(spark, "orc-tokens")
    tokenfile.write_tokens(documents(spark, sf_dir), path)
    return tokenfile.catalog(tokenfile.read_tokens(spark, path))


def op2_risk_controlled_rules(spark, sf_dir):
    """Word measures, base rules, and the verdict of the cutoffs certified on ``labels``."""
    measured = staged(documents(spark, sf_dir).select("doc_id", quality.measures().alias("m")), "measures")
    chosen = quality.fit(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return measured.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
                           quality.base_failed("m").alias("base_failed"), quality.kept("m", chosen).alias("kept"),
                           quality.stratum("m").alias("stratum"), quality.score("m").alias("score"),
                           quality.cutoff("m", chosen).alias("cutoff"))


def op3_byte_bpe(spark, sf_dir):
    """Token counts and digests of the ids and of the decoded bytes of every document."""
    return bytebpe.encode_documents(documents(spark, sf_dir), with_ids=False)


def op4_curriculum_mix(spark, sf_dir):
    """Words taken of each document by the curriculum mix, with the times of its passes."""
    plan = mixing.plan_mix(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken",
                       *[F.round(F.get("passes", F.lit(p))["position"], 6).alias(f"position_{p + 1}") for p in range(mixing.MAX_PASSES)])


def op5_dart_minhash(spark, sf_dir):
    """Classes of near-duplicate documents: 5-word shingles, similarity 0.8 or more."""
    return dartminhash.near_duplicates(documents(spark, sf_dir))


def op6_randomness_secrets(spark, sf_dir):
    """Secrets by fixed patterns and by the randomness battery."""
    found = randomness.secrets(documents(spark, sf_dir))
    return found.select("doc_id", *[randomness.count_of("base", k).alias(f"n_{k}") for k in randomness.KINDS[:3]],
                        F.sha2(randomness.listed("base"), 256).alias("base_sha256"), randomness.listed("spans").alias("spans"),
                        randomness.count_of("spans", "random").alias("n_random"))


def op7_edit_counts(spark, sf_dir):
    """Token counts of every document before and after edits, kept by segment trees."""
    state = editcount.build_state(documents(spark, sf_dir))
    edited = editcount.apply_edits(state.withColumn("edits", editcount.sample_edits()))
    return edited.select("doc_id", "result.n_tokens", F.size("edits").cast("long").alias("n_edits"), "result.edited_tokens",
                         "result.recounted", F.sha2("result.text", 256).alias("edited_sha256"))


def op8_tree_merge_dedup(spark, sf_dir):
    """Exact duplicates: of equal texts the row with the largest id stays."""
    return exact_dedup.dedup_report(documents(spark, sf_dir))


def op9_kneser_ney_langid(spark, sf_dir):
    """Language of every document by character models learned from the documents that are not held out."""
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op10_rendezvous_shards(spark, sf_dir):
    """16 equal shards by rendezvous hashing of doc_id, slots, and the shard if there were 17."""
    assigned = rendezvous.assign(documents(spark, sf_dir), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return rendezvous.with_slots(assigned).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                                                  "slot", "grown_shard")


def op11_importance_resampling(spark, sf_dir):
    """Documents drawn in proportion to how much their words look like the benchmark's."""
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_impact_topk(spark, sf_dir):
    """The 5 best other vectors by integer inner product for every vector whose id is divisible by 50."""
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


def op13_collocations(spark, sf_dir):
    """The first 2000 collocations of every language."""
    return collocations.collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_orc_tokens, op2_risk_controlled_rules, op3_byte_bpe, op4_curriculum_mix, op5_dart_minhash,
                                     op6_randomness_secrets, op7_edit_counts, op8_tree_merge_dedup,
                                     op9_kneser_ney_langid, op10_rendezvous_shards, op11_importance_resampling, op12_impact_topk,
                                     op13_collocations)}


def _invert_sql(share: str, rates: tuple, knots: tuple) -> str:
    """``mixing.invert_schedule`` as SQL."""
    areas = [(b - a) * (r + s) / 2 for a, b, r, s in zip(knots, knots[1:], rates, rates[1:])]
    done, cases = 0.0, ""
    for a, b, r, s, area in zip(knots, knots[1:], rates, rates[1:], areas):
        rest = f"(greatest({share} - {done / sum(areas)!r}::DOUBLE, 0) * {sum(areas)!r}::DOUBLE)"
        root = f"sqrt({r * r!r}::DOUBLE + {rest} * {2 * (s - r) / (b - a)!r}::DOUBLE)"
        done += area
        cases += f" WHEN {share} < {done / sum(areas)!r}::DOUBLE THEN least({a!r}::DOUBLE + 2 * {rest} / ({r!r}::DOUBLE + {root}), {b!r}::DOUBLE)"
    return f"CASE{cases} ELSE {knots[-1]!r}::DOUBLE END"


def _mix_sql() -> str:
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    taken = [f"greatest(least(round(target)::BIGINT - (start + {p} * source_size), size), 0)" for p in range(mixing.MAX_PASSES)]

    def position(p: int) -> str:
        share = f"((start + {p} * source_size + taken_{p + 1} / 2.0::DOUBLE) / target)"
        cases = " ".join(f"WHEN class = {c} THEN {_invert_sql(share, r, mixing.KNOTS)}" for c, r in enumerate(mixing.SCHEDULES))
        return f"CASE WHEN taken_{p + 1} > 0 THEN round(CASE {cases} END, 6) END AS position_{p + 1}"

    return f"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0)::BIGINT AS size,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS place FROM documents),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r
            FROM sized GROUP BY source),
        weighed AS (
            SELECT *, (r - 1) % {len(mixing.WEIGHTS)} AS class, 2 * source_size AS cap,
                   {list(mixing.WEIGHTS)}[((r - 1) % {len(mixing.WEIGHTS)} + 1)::INT]::DOUBLE AS w FROM sources),
        filling AS (
            SELECT *, sum(source_size) OVER ()::DOUBLE * {mixing.VOLUME}::DOUBLE - coalesce(sum(cap) OVER f, 0)::DOUBLE AS rest,
                   sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS rest_w
            FROM weighed WINDOW f AS (ORDER BY cap::DOUBLE / w, r {before})),
        targets AS (
            SELECT *, CASE WHEN cap * rest_w <= w * rest THEN cap::DOUBLE
                      ELSE w * max(CASE WHEN cap * rest_w > w * rest THEN rest / rest_w END) OVER () END AS target FROM filling),
        streamed AS (
            SELECT s.doc_id, s.size, t.source_size, t.target, t.class,
                   coalesce(sum(s.size) OVER (PARTITION BY t.r ORDER BY place, doc_id NULLS LAST, size {before}), 0)::BIGINT AS start
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
        passes AS (SELECT *, {", ".join(f"{t}::BIGINT AS taken_{p + 1}" for p, t in enumerate(taken))} FROM streamed)
        SELECT doc_id, size, source_size, target, ({" + ".join(f"taken_{p + 1}" for p in range(mixing.MAX_PASSES))})::BIGINT AS taken,
               {", ".join(position(p) for p in range(mixing.MAX_PASSES))} FROM passes"""


def _quality_sql() -> str:
    first = quality.STRATA
    stratum = "CASE " + " ".join(f"WHEN n_words >= {n} THEN {i}" for i, n in reversed(list(enumerate(first)))) + " END"
    share = lambda x, y: f"CASE WHEN {y} > 0 THEN {x} / {y} ELSE 0::DOUBLE END"
    shares = {"symbols": share("n_symbols", "word_chars"), "marks": share("n_marks", "word_chars"), "upper": share("n_upper", "n_letters"),
              "lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words")}
    score = ", ".join(f"{shares[k]} / {v}::DOUBLE" for k, v in quality.SCALES.items())
    only = lambda chars: f"length(regexp_replace(coalesce(text, ''), '[^{chars}]', '', 'g'))"
    log = "lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1)"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(regexp_extract_all(text, '{mixing.WORD}'), []) AS ws FROM documents),
        words AS (SELECT rid, unnest(ws) AS a, unnest(range(len(ws))) AS i FROM d),
        windows AS (SELECT rid, i, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM words WINDOW w AS (PARTITION BY rid ORDER BY i)),
        twice AS (SELECT rid, a, b, c FROM windows WHERE c IS NOT NULL GROUP BY rid, a, b, c HAVING count(*) > 1),
        hit AS (SELECT DISTINCT rid, i + k AS at_word FROM windows JOIN twice USING (rid, a, b, c), range(3) r(k)),
        repeated AS (SELECT rid, count(*) AS n_repeat_words FROM hit GROUP BY rid),
        lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
                  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{mixing.WORD}') GROUP BY rid),
        m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                     {only('#*$%&|<>')} AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
                     coalesce(n_repeat_words, 0) AS n_repeat_words, {only('!')} AS n_marks, {only('A-Z')} AS n_upper, {only('A-Za-z')} AS n_letters
              FROM d LEFT JOIN lines USING (rid) LEFT JOIN repeated USING (rid)),
        rated AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {stratum} AS stratum,
                         greatest({score}) AS score FROM m),
        marks AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
        counts AS (SELECT stratum, c, count(*) FILTER (q = 1) AS good, count(*) FILTER (q = 0) AS bad,
                          count(*) FILTER (q = 1 AND score >= c) AS k, count(*) FILTER (q = 0 AND score >= c) AS hits
                   FROM rated JOIN marks USING (doc_id), (SELECT unnest({list(quality.CUTOFFS)})::DOUBLE AS c) WHERE NOT base_failed GROUP BY stratum, c),
        certified AS (SELECT * FROM counts WHERE k < {quality.ALPHA} * good AND list_sum(list_transform(range(k + 1),
                      lambda i: exp({log} + i * ln({quality.ALPHA}) + (good - i) * ln(1 - {quality.ALPHA})))) <= {quality.DELTA / len(first) / len(quality.CUTOFFS)!r}),
        chosen AS (SELECT stratum, c AS cutoff, row_number() OVER (PARTITION BY stratum ORDER BY
                   CASE WHEN bad > 0 THEN hits / bad ELSE 0 END - k / good DESC, c DESC) AS nth FROM certified)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND coalesce(score < cutoff, true) AS kept, stratum, score, cutoff
        FROM rated LEFT JOIN (SELECT * FROM chosen WHERE nth = 1) USING (stratum)"""


def _near_sql() -> str:
    """Classes by comparing all texts that share a shingle."""
    k = dartminhash.SHINGLE
    return f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{mixing.WORD}'), []) AS ws FROM documents),
        keyed AS (SELECT doc_id, ws, array_to_string(ws, ' ') AS key FROM d),
        nodes AS (SELECT key, min(doc_id) AS node, any_value(ws) AS ws FROM keyed WHERE len(ws) > 0 GROUP BY key),
        places AS (SELECT node, ws, unnest(range(1, greatest(len(ws) - {k - 1}, 1) + 1)) AS i FROM nodes),
        weights AS (SELECT node, array_to_string(ws[i:i + {k - 1}], ' ') AS g, count(*) AS n FROM places GROUP BY node, g),
        totals AS (SELECT node, sum(n) AS total FROM weights GROUP BY node),
        shared AS (SELECT x.node AS a, y.node AS b, sum(least(x.n, y.n)) AS both_have FROM weights x JOIN weights y ON x.g = y.g AND x.node <> y.node
                   GROUP BY x.node, y.node),
        links AS (SELECT a, b FROM shared JOIN totals u ON u.node = a JOIN totals v ON v.node = b
                  WHERE both_have >= {dartminhash.THRESHOLD} * (u.total + v.total - both_have)),
        reach AS (SELECT node, node AS other FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
        classed AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node),
        mapped AS (SELECT key, class_id FROM nodes JOIN classed USING (node)),
        placed AS (SELECT doc_id, coalesce(class_id, doc_id) AS class_id FROM keyed LEFT JOIN mapped USING (key))
        SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM placed"""


#: Table ``steps`` of the 256 steps of crc32, and one step of it over a byte.
CRC_STEPS = """steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::BIGINT], range(8)),
                  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps)"""
CRC_STEP = "lambda c, b: xor(c // 256, steps[(xor(c, b) % 256 + 1)::INT])"


def _crc_sql(text: str) -> str:
    """crc32 of the UTF-8 bytes of ``text``; needs ``steps`` in the FROM clause."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {data}), {CRC_STEP}), 4294967295)"


def _shards_sql() -> str:
    u = "((('0x' || substr(md5(k || ':' || i), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"
    return f"""
        WITH {CRC_STEPS},
        d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
        coded AS (SELECT rid, doc_id, k, strlen(t) + 1 AS size, {_crc_sql("t")} AS text_crc32 FROM d, steps),
        rated AS (SELECT rid, i, 1 / -ln({u}) AS score FROM d, range({SHARDS + 1}) r(i)),
        won AS (SELECT rid, (arg_max(i, score) FILTER (i < {SHARDS}))::INT AS shard, arg_max(i, score)::INT AS grown_shard FROM rated GROUP BY rid)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k), 1, 13))::BIGINT,
               doc_id NULLS LAST, text_crc32, size) - 1 AS slot, grown_shard FROM coded JOIN won USING (rid)"""


def _importance_sql() -> str:
    """Crc32 of each distinct word by its table-driven form, then gains, weights, scores and the draw."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    size = importance.BUCKETS
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM documents),
        b AS (SELECT {words} AS ws FROM benchmark),
        {CRC_STEPS},
        vocabulary AS (SELECT DISTINCT unnest(ws) AS w FROM (SELECT ws FROM d UNION ALL SELECT ws FROM b)),
        coded AS (SELECT w, {_crc_sql("w")} % {size} AS bucket FROM vocabulary, steps),
        uses AS (SELECT rid, bucket, count(*) AS n FROM (SELECT rid, unnest(ws) AS w FROM d) JOIN coded USING (w) GROUP BY rid, bucket),
        own AS (SELECT bucket, sum(n) AS s FROM uses GROUP BY bucket),
        target AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(ws) AS w FROM b) JOIN coded USING (w) GROUP BY bucket),
        gains AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM own), 0) + {size})::DOUBLE)
                  / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM target), 0) + {size})::DOUBLE)))::BIGINT AS gain FROM own LEFT JOIN target USING (bucket)),
        sums AS (SELECT rid, sum(n * gain)::BIGINT AS total FROM uses JOIN gains USING (bucket) GROUP BY rid),
        weighed AS (SELECT rid, doc_id, len(ws)::BIGINT AS n_features, CASE WHEN len(ws) = 0 THEN 0
                    ELSE ((total - ((total % len(ws)) + len(ws)) % len(ws)) // len(ws)) END::BIGINT AS weight,
                    ('0x' || substr(sha256('{importance.SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM d LEFT JOIN sums USING (rid)),
        scored AS (SELECT rid, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
        ranked AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id, rid) AS nth, count(*) OVER () AS able
                   FROM scored WHERE n_features >= {importance.MIN_WORDS})
        SELECT doc_id, n_features, weight, score, CASE WHEN nth <= {importance.PERCENT} * able // 100 THEN nth END AS rank
        FROM scored LEFT JOIN ranked USING (rid)"""


def _collocation_sql() -> str:
    longest, unit = collocations.LONGEST, collocations.UNIT
    part = lambda a, b: f"array_to_string(ws[{a}:{b}], ' ')"
    return f"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
        split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
        totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM split GROUP BY lang),
        places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM split),
        spans AS (SELECT lang, unnest(list_transform(range(least({longest}, len(ws) - i + 1)), lambda k: ws[i:i + k])) AS ws FROM places),
        counts AS (SELECT lang, ws, count(*) AS f FROM spans GROUP BY lang, ws HAVING count(*) >= {collocations.LEAST}),
        f AS (SELECT lang, {part(1, longest)} AS phrase, f FROM counts),
        cuts AS (SELECT lang, ws, f AS a, unnest(range(1, len(ws))) AS k FROM counts WHERE len(ws) > 1),
        rated AS (SELECT c.lang, c.ws, c.a, c.k, x.f AS l, y.f AS r, ({2 * unit}::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score FROM cuts c
                  JOIN f x ON x.lang = c.lang AND x.phrase = {part(1, "k")} JOIN f y ON y.lang = c.lang AND y.phrase = {part("k + 1", "len(ws)")}),
        lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) AS nth FROM rated),
        candidates AS (SELECT lang, ws, {part(1, longest)} AS phrase, a, l, r, score FROM lowest WHERE nth = 1),
        inner_of AS (SELECT lang, a, ws, unnest(range(2, len(ws))) AS size FROM candidates WHERE len(ws) > 2),
        inside AS (SELECT lang, a, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM inner_of),
        covers AS (SELECT lang, {part("i", "i + size - 1")} AS phrase, max(a) AS most FROM inside GROUP BY ALL),
        left_over AS (SELECT c.* FROM candidates c LEFT JOIN covers v USING (lang, phrase) WHERE v.most IS NULL OR 100 * v.most < {collocations.COVER} * c.a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {collocations.TOP}"""


_TOPK_SQL = f"""
        WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
                   FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {topk.TOP}"""

ORACLE_SQL = {
    "op10_rendezvous_shards": _shards_sql(),
    "op11_importance_resampling": _importance_sql(),
    "op12_impact_topk": _TOPK_SQL,
    "op13_collocations": _collocation_sql(),
    "op2_risk_controlled_rules": _quality_sql(),
    "op4_curriculum_mix": _mix_sql(),
    "op5_dart_minhash": _near_sql(),
    "op8_tree_merge_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}

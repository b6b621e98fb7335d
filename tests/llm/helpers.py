"""Awkward documents for the operators' tests: nulls, empties, ties, repeated rows, very long texts, clashing columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "size string, kept string, row string, id string, shard string, label string, m string, tree string")


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abdeilmnorst") for _ in range(r.randint(1, 3))) + str(r.randint(0, vocabulary))[:2] for _ in range(n))


def awkward_rows():
    a, b, long = words(120, 1), words(80, 2), words(30_000, 3)
    near = a.split()
    near[60] = "changed"
    texts = [(1, a, "en", "s1"), (2, a, "en", "s0"), (2, a, "en", "s0"), (3, " ".join(near), "de", "s1"), (4, "", "en", "s2"),
             (5, None, None, None), (None, None, "en", None), (None, b, None, "s1"), (6, b, "de", "s1"), (7, long, "de", "é"),
             (8, " \n\t ", "en", "s2"), (9, "one", "en", "S"), (10, "one two three", "de", "S"), (10, "other text", "de", "S"),
             (11, "x " * 500, "en", "s0"), (12, "line one\nline one\n\nline one\r\n", "en", "s0"),
             (13, "ÀÉ ñ 漢字 🙂 end ", "fr", "s3"), (14, "nul\u0000 in text <|endoftext|>", None, "s3"), (15, a.replace(" ", "\n"), "en", "s1")]
    return [(i, t, lang, s, None if t is None else len(t), *(["x"] * 8)) for i, t, lang, s in texts]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

"""Small documents with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("key", T.StringType()), T.StructField("node", T.IntegerType()), T.StructField("size", T.IntegerType())])


def words(rng, n, vocabulary):
    return [rng.choice(vocabulary) for _ in range(n)]


def changed(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return w


def documents(seed=3):
    """(doc_id, text, lang, source) rows."""
    rng = random.Random(seed)
    vocabulary = {"en": [rng.choice("bdfgt") + rng.choice("aeiou") + rng.choice(["th", "ing", "sh"]) for _ in range(400)], "de": [rng.choice("kzpv") + rng.choice("äöüe") + rng.choice(["cht", "ung", "sch"]) for _ in range(400)]}
    rows, i = [], 0
    for g in range(12):
        lang = ("en", "de")[g % 2]
        base = words(rng, rng.choice([6, 40, 200, 300]), vocabulary[lang])
        for _ in range(rng.choice([1, 2, 6])):
            rows.append((i, " ".join(base), lang, f"s{g % 3}"))
            i += 1
        for _ in range(rng.choice([0, 3, 8])):
            rows.append((i, "\n".join([" ".join(changed(rng, base, rng.choice([0, 1, 2, 5, 9])))]), lang, f"s{g % 3}"))
            i += 1
    rows += [(i, None, "en", None), (i + 1, "", None, "s1"), (i + 2, " \n\t ", "de", "s1"), (i + 3, "one two", "en", "s2"), (i + 4, "One  TWO", None, "s2"), (i + 5, " ".join(words(rng, 30_000, vocabulary["en"])), "en", "s0"), (i + 6, "12 34 !!", "en", "s0"), (None, "lonely text of no id but with some words in it", "en", "s0"), (0, rows[0][1], "en", "s0"), (i + 7, "x" * 5000, None, "s9")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

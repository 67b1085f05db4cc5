"""Small corpora with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("size", "taken", "position", "target", "fp", "tkey", "root", "row", "spans", "base_spans", "kept", "n_words", "anchor", "held", "component_id", "bucket")


def words(seed, n, pool=400):
    r = random.Random(seed)
    vocab = [f"w{k}{'aeiou'[k % 5]}" for k in range(pool)]
    return " ".join(r.choice(vocab) for _ in range(n))


def odd_rows():
    base, passage = words(1, 120), words(2, 60)
    rows = [(0, base), (1, base), (2, base.upper()), (3, None), (4, ""), (5, "   \n\t "), (6, "one"), (7, "one two three"), (7, "one two three"), (None, "no id at all here"), (None, None)]
    rows += [(10 + i, f"{words(100 + i, 40)} {passage} {words(200 + i, 30 + i)}") for i in range(8)]
    rows += [(30, words(5, 6000)), (31, "x" * 30000), (32, "ab " * 4000), (33, "É日本😀 " * 50), (34, "same line\n" * 30)]
    rows += [(40 + i, words(6, 80) + f" tail{i}") for i in range(12)]
    return [(i, t, "en", None if i is None or i % 4 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in rows]


def odd(spark, clashing=False):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("mine") for c in CLASHING}) if clashing else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

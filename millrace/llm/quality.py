"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is an SQL condition on measures of a text.  One job over a sample counts which rules reject what, and how many
characters, words and lines that has; a rule's cost is that of the measures it needs which no rule before it has
made, by what a character, a word or a line of them costs.  The cascade asks the rules in the order of rejections per
cost among what is left.  A rule's measures are computed just before it is asked and once, for the texts that the
rules before it have left.  The order changes the cost and which rule is named; whether a text is kept does not
change, and the same rows give the same order.  The sample is random rows, `sample_rows` of them on average, found
in one scan of the texts; measures and verdicts cover every row and the whole text.  Windows and words are told apart
by 64-bit hashes.

Edge cases: null and empty texts have no words, all measures are zero and the words rule rejects them; repeated
rows are judged each for itself; measures replace columns of the same name (names that begin with __ are the
cascade's own); an empty table keeps the given order.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, n_words, table
from .common import bound as _bound

#: Characters that count as symbols, and white space of the contract.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5


def _repeated(words: Column) -> Column:
    """Words inside windows of WINDOW words whose sequence stands twice or more in the text."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = _bound(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(WINDOW)])))

    def marks(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        twin = lambda p: F.filter(p, lambda x, j: (x["g"] == F.get(p, j - 1)["g"]) | (x["g"] == F.get(p, j + 1)["g"]))
        places = F.sort_array(F.transform(_bound(ordered, twin), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + WINDOW).alias("upto"), (a["n"] + i + WINDOW - F.greatest(a["upto"], i)).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    return F.when(F.size(words) > WINDOW, _bound(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), marks(g)).otherwise(0))).otherwise(0)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)


def _measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return {
        "word_chars": F.length(F.translate(text, BLANKS, "")),
        "n_symbols": count(SYMBOLS),
        "n_exclaims": count("!"),
        "n_lines": F.size(lines),
        "n_dup_lines": _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _bound(words, _repeated),
    }


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_exclaims, n_lines (with a word), n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = _words(text)
    return docs.withColumns({k: v.cast("long") for k, v in {"n_words": F.size(words), **_measures(text, words, _lines(text))}.items()})


#: What is rejected: the two base rules, then symbols, shouting, repeated lines and odd word lengths.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "shouting": "2 * n_exclaims > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}
BASE_RULES = ("few_words", "repeated_words")
#: The lists that measures are taken from.
_LISTS = {"n_lines": "lines", "n_dup_lines": "lines", "n_repeat_words": "words"}


def _once(value: Column) -> Column:
    """value, in a form that the optimiser computes where it stands: it is not copied into each filter that reads it."""
    return F.when(F.spark_partition_id() >= 0, value)


def _cascade(docs: DataFrame, rules: Mapping[str, str], order: list[str]) -> DataFrame:
    """The rows of docs that no rule rejects, with columns of the cascade's own besides."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lists = {"words": _words(text), "lines": _lines(text)}
    make = {"n_words": n_words(), **_measures(text, F.col("__words"), F.col("__lines"))}
    there = set()
    for name in order:
        own = [m for m in make if re.search(rf"\b{m}\b", rules[name])]
        for column, value in [(_LISTS[m], lists[_LISTS[m]]) for m in own if m in _LISTS] + [(m, make[m].cast("long")) for m in own]:
            if column not in there:
                docs = docs.withColumn(f"__{column}", _once(value))
                there.add(column)
        docs = docs.where(~F.coalesce(F.expr(re.sub(rf"\b({'|'.join(make)})\b", r"__\1", rules[name])), F.lit(False)))
    return docs


#: What a measure costs for each character, word and line of a text: weights set by hand after the passes that it makes,
#: not measured.  They decide the order of the rules only.
COSTS = {
    "n_words": (9.0, 0.0, 0.0),
    "word_chars": (4.0, 0.0, 0.0),
    "n_symbols": (4.0, 0.0, 0.0),
    "n_exclaims": (4.0, 0.0, 0.0),
    "lines": (6.0, 0.0, 60.0),
    "n_lines": (0.0, 0.0, 0.0),
    "n_dup_lines": (0.0, 0.0, 80.0),
    "words": (13.0, 15.0, 0.0),
    "n_repeat_words": (0.0, 600.0, 0.0),
}


def _needs(rule: str) -> list[str]:
    """The columns that a rule reads and the lists that they are taken from."""
    own = [m for m in COSTS if re.search(rf"\b{m}\b", rule)]
    return [*dict.fromkeys(_LISTS[m] for m in own if m in _LISTS), *own]


def cascade_order(docs: DataFrame, rules: Mapping[str, str], sample_rows: int = 1000) -> list[str]:
    """The rules' names by rejections per cost, best first, each among what the ones before it have left.

    One job over a sample counts its rows, characters, words and lines by which rules reject them.  A rule costs what
    its measures do that are not there yet, for what is left; so the same rows give the same order.
    """
    n = docs.count()  # of a Parquet table: from its footers
    sample = docs.select("text").sample(min(1.0, sample_rows / max(1, n)), seed=20240229)
    bits = [F.coalesce(F.expr(rule), F.lit(False)).cast("int").cast("string") for rule in rules.values()]
    size = [F.sum(F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))), F.sum("n_words"), F.sum("n_lines")]
    # as many groups as sampled rows at most
    groups = measured(sample).groupBy(F.concat(*bits).alias("bits")).agg(F.count("*").alias("n"), *(s.alias(f"s{i}") for i, s in enumerate(size))).collect()
    order, there, names = [], set(), list(rules)

    def rate(name: str) -> float:
        at = names.index(name)
        cost = sum(c * sum(g[f"s{i}"] for g in groups) for m in _needs(rules[name]) if m not in there for i, c in enumerate(COSTS[m]))
        return sum(g["n"] for g in groups if g["bits"][at] == "1") / max(cost, 1.0)

    while len(order) < len(names):
        best = max((x for x in names if x not in order), key=rate)
        order.append(best)
        there.update(_needs(rules[best]))
        groups = [g for g in groups if g["bits"][names.index(best)] == "0"]
    return order


def judged(docs: DataFrame, rules: Mapping[str, str] | None = None, sample_rows: int = 1000) -> DataFrame:
    """docs with their measures and `rejected_by`: the first rule of the cascade that rejects, or null."""
    rules = rules or RULES
    verdict = F
    for name in cascade_order(docs, rules, sample_rows):
        verdict = verdict.when(F.expr(rules[name]), F.lit(name))
    return measured(docs).withColumn("rejected_by", verdict)


def passed(docs: DataFrame, rules: Mapping[str, str] | None = None, sample_rows: int = 1000) -> DataFrame:
    """The rows of docs that no rule rejects, columns unchanged; each rule sees what the ones before it have kept."""
    rules = rules or RULES
    return _cascade(docs, rules, cascade_order(docs, rules, sample_rows)).select(*[f"`{c}`" for c in docs.columns])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.expr(" OR ".join(RULES[name] for name in BASE_RULES))
    found = judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twins AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM twins) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims,
         len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words OR 2 * n_exclaims > n_words
            OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM m
"""

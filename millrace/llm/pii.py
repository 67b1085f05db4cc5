"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

The base patterns (fixed values, below) give the seeds, and long mixed hexadecimal strings are seeds of a fifth kind,
secrets.  Every identifier-like token is an instance.  Its lexical patterns are the two words before it, the word
before it, the word after it (lower-cased, digits as zeros, read within CONTEXT code points; one without a letter is
none) and its own shape.  The
graph of patterns and instances is scored in rounds.  A seed scores 1.  What has a kind's form and fails its check (a
number that is no card) counts against every pattern and is never named.  Any other instance scores, for the judgement
of a pattern, as the surest pattern of the other views that it is met in; the views are the words before it, the
word after it and its own form, so no pattern proves itself or its like, and words can vouch for words.  A pattern's
confidence for a kind is the lower bound of its share, given how many instances it has: those of which nothing is
known count in part, since they are what patterns are asked for.  A pattern also needs `support` instances that score at least `confidence`.  Patterns of that confidence name unseen identifiers at
their places, where no base span is; a secret is named only so, whatever its form.  Both sides of the graph are
aggregated before they are joined, so a context that a third of all texts share is a row.

Positions are code points, from the pieces between matches.  Texts are told apart by a 64-bit hash.  Edge cases: null
and empty texts have no spans; repeated rows get the same spans; quantifiers that cannot backtrack keep very long
texts linear; columns named like the result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound as _bound
from .common import stored, table

# The base patterns by kind, written so that a failed start is not tried again further on.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind at all; asked first, because most texts don't.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
KINDS = tuple(PATTERNS)
ALL_KINDS = (*KINDS, "secret")
SPAN = "array<struct<kind:string,start:int,stop:int>>"
#: The digits of a card as a token of their own.
WHOLE_CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+(?![0-9A-Za-z:/@]|\.[0-9])"
#: A token with a digit or an at sign.
IDENTIFIER = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: What is no part of a token: opening signs, and all signs at its end.
LEAD, TAIL = r"^[\x22'(<\[{,;:]++", r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$"
#: The form of seeds of the kind secret: 32 hexadecimal digits or more, letters among them.
SECRET = r"^(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}+$"
#: Code points on each side of a token in which its context is read.
CONTEXT = 80
#: The patterns of a token itself; the others are of the words around it.
OWN = ("shape", "form", "checked")
#: Which patterns are one view of a token.
VIEWS = {"two before": "left", "before": "left", "after": "right", **dict.fromkeys(OWN, "own")}
#: The mark of a token that has a kind's form and fails its check.
REFUSED = "none"
#: What an instance of which nothing is known counts in a pattern, and the squared score of the lower bound.
DOUBT, Z2 = 0.25, 1.96**2
_CANDIDATE = "array<struct<token:string,start:int,stop:int,left:string,right:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(each, lambda d, i: F.when(i % 2 == 1, twice(d)).otherwise(d)), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(_digits(match)).between(13, 19) & _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _located(text: Column, pattern: str, contexts: bool = False, block: int = 256) -> Column:
    """array of (token, start, stop, left, right): each match of a pattern, its code points, and what stands around it.

    left and right are null unless contexts are asked for.  Positions are running sums of lengths, within blocks and
    then over blocks, so long arrays are not copied often.
    """
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    fields = ("left", "right")

    def placed(x: Column, start: Column) -> Column:
        return F.struct(x["token"].alias("token"), start.alias("start"), (start + F.length(x["token"])).alias("stop"), *[x[f].alias(f) for f in fields])

    def step(a: Column, x: Column) -> Column:
        start = a["upto"] + x["gap"]
        return F.struct((start + F.length(x["token"])).alias("upto"), F.array_append(a["found"], placed(x, start)).alias("found"))

    def shift(a: Column, b: Column) -> Column:
        moved = F.transform(b["found"], lambda x: placed(x, a["upto"] + x["start"]))
        return F.struct((a["upto"] + b["upto"]).alias("upto"), F.array_append(a["found"], moved).alias("found"))

    def by_blocks(both: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / block).cast("int")), lambda i: F.slice(both, i * block + 1, F.lit(block)))
        local = F.transform(blocks, lambda x: F.aggregate(x, F.struct(F.lit(0).alias("upto"), F.array().cast(_CANDIDATE).alias("found")), step))
        return F.aggregate(local, F.struct(F.lit(0).alias("upto"), F.array().cast(f"array<{_CANDIDATE}>").alias("found")), shift, lambda a: F.flatten(a["found"]))

    def around(p: Column, i: Column) -> list[Column]:
        if not contexts:
            return [F.lit(None).cast("string").alias(f) for f in fields]
        return [F.substring(F.get(p, i), -CONTEXT, CONTEXT).alias("left"), F.substring(F.get(p, i + 1), 1, CONTEXT).alias("right")]

    both = _bound(pieces, lambda p: F.transform(matches, lambda m, i: F.struct(m.alias("token"), F.length(F.get(p, i)).alias("gap"), *around(p, i))))
    return _bound(both, lambda x: F.when(F.size(x) > 0, by_blocks(x)).otherwise(F.array().cast(_CANDIDATE)))


def _is_valid(kind: str, x: Column) -> Column:
    return _valid(kind, x["token"])


def _span(kind: str, x: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def base_spans(text: Column) -> Column:
    """The base patterns' spans, by kind as listed and then by start."""
    found = []
    for kind, pattern in PATTERNS.items():
        good = F.filter(_located(text, pattern), partial(_is_valid, kind))
        spans = F.transform(good, partial(_span, kind))
        found.append(F.when(text.rlike(HINTS[kind]), spans.cast(SPAN)).otherwise(F.array().cast(SPAN)))
    return F.concat(*found)


def located(docs: DataFrame) -> DataFrame:
    """(tkey, base, found): a row per distinct text that may hold an identifier, with base spans and identifier-like tokens.

    A base match is one token, whatever white space it holds; of digits, only if there are enough for a card and no more
    of the token follows.
    """
    text = F.col("text")
    base = "|".join(f"(?:{p})" for p in (PATTERNS | {"card": WHOLE_CARD}).values())
    texts = docs.select(F.col("text").cast("string").alias("text")).where(text.rlike("[0-9@]"))
    rows = texts.select(F.xxhash64("text").alias("tkey"), base_spans(text).alias("base"), _located(text, f"{base}|{IDENTIFIER}", True).alias("found"))
    return rows.where("size(found) > 0").dropDuplicates(["tkey"])


def _kind_of(token: Column) -> Column:
    """The base kind that a whole token is of, or null."""
    kind = F
    for k, p in PATTERNS.items():
        kind = kind.when(token.rlike(f"^(?:{p})$") & _valid(k, token), F.lit(k))
    return kind.otherwise(F.lit(None).cast("string"))


def _refused(token: Column) -> Column:
    """Whether a whole token has the form of a kind and fails its check; few digits are no card's form, parts of many no address's."""
    enough = {"card": F.length(_digits(token)).between(13, 19), "ip": token.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")}
    return F.coalesce(*[F.when(token.rlike(f"^(?:{PATTERNS[k]})$") & enough.get(k, F.lit(True)) & ~_valid(k, token), F.lit(True)) for k in KINDS if k != "email"], F.lit(False))


def _shape(token: Column) -> Column:
    """Digits as zeros and runs of letters as one; of a long mix of letters and digits only the length."""
    mixed = (F.length(token) >= 16) & token.rlike("^(?=[0-9]*[A-Za-z])(?=[A-Za-z]*[0-9])[0-9A-Za-z]++$")
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[0-9]", "0"), r"\p{Lu}++", "A"), r"[\p{L}&&[^\p{Lu}]]++", "a")
    return F.when(mixed, F.concat(F.lit("mixed "), F.length(token).cast("string"))).otherwise(runs)


def candidates_of(located_: DataFrame) -> DataFrame:
    """(tkey, start, stop, token, seed, patterns): tokens at their places, the kind they are seeds of, their (side, context)s."""
    blank = "[\x20\x09-\x0D]"
    rows = located_.select("tkey", F.inline("found").alias("match", "from", "upto", "left", "right"))
    bare = F.regexp_replace("match", LEAD, "")
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]", "0"), rf"{blank}++", " "))
    rows = rows.select("tkey", (F.col("from") + F.length("match") - F.length(bare)).alias("start"), F.regexp_replace(bare, TAIL, "").alias("token"), plain(F.col("left")).alias("left"), plain(F.col("right")).alias("right"))
    rows = rows.where(F.length("token") > 0).withColumn("seed", F.coalesce(_kind_of(F.col("token")), F.when(F.col("token").rlike(SECRET), F.lit("secret")), F.when(_refused(F.col("token")), F.lit(REFUSED))))
    two, after = F.regexp_extract("left", r"([^ ]++ )?[^ ]++$", 0), F.regexp_extract("right", r"^[^ ]++", 0)
    sides = {"two before": two, "before": F.regexp_extract("left", r"[^ ]++$", 0), "after": after}
    spoken = [F.when(c.rlike(r"\p{L}") & (c.contains(" ") if side == "two before" else F.lit(True)), F.struct(F.lit(side).alias("side"), c.alias("context"))) for side, c in sides.items()]
    shape, digits = _shape(F.col("token")), _digits(F.col("token"))
    form = F.regexp_replace(shape, "0++", "0")
    checked = F.when(F.length(digits).between(12, 19) & _luhn(digits), F.concat(F.length(digits), F.lit(" digits")))
    spoken += [F.when(c.isNotNull(), F.struct(F.lit(side).alias("side"), c.alias("context"))) for side, c in zip(OWN, (shape, form, checked), strict=True)]
    stop = (F.col("start") + F.length("token")).alias("stop")
    return rows.select("tkey", "start", stop, "token", "seed", F.array_compact(F.array(*spoken)).alias("patterns"))


def _alike(kind: Column, token: Column) -> Column:
    """Whether an unseen token can stand for a kind at all."""
    n = F.length(_digits(token))
    secret = (F.length(token) >= 16) & (n > 0) & token.rlike("[A-Za-z]") & ~token.contains("@")
    return F.when(kind == "email", token.contains("@") & (F.length(token) >= 5)).when(kind == "ip", (n >= 4) & token.rlike("[.:]")).when(kind == "card", n >= 12).when(kind == "secret", secret).otherwise(n >= 7)


def _view(side: Column) -> Column:
    return F.when(side.isin(*OWN), "own").when(side == "after", "right").otherwise("left")


def _lower(mass: Column, n: Column) -> Column:
    """The lower end of the interval in which a share of mass / n lies (Wilson's, 95 %)."""
    p = mass / n
    return (p + Z2 / (2 * n) - Z2**0.5 * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p)) / n + Z2 / (4 * n * n))) / (1 + Z2 / n)


def bootstrap(candidates: DataFrame, rounds: int = 3, confidence: float = 0.75, support: int = 5) -> DataFrame:
    """(side, context, kind, confidence) of the patterns that the scored graph trusts."""
    p = ["side", "context"]
    edges = candidates.select("token", "seed", F.inline("patterns")).distinct()
    # stored, so that a join has plain shuffles on both sides and a hot context's rows can be split
    edges = stored(edges, "edges")
    shared = stored(edges.groupBy(p).agg(F.count("*").alias("degree"), F.count("seed").alias("known")).where(F.col("degree") >= support), "degrees")
    edges = stored(edges.join(shared, p), "patterns")
    both = [F.first("degree").alias("degree"), F.first("known").alias("known")]
    seeds = edges.where(F.col("seed") != REFUSED).groupBy(*p, F.col("seed").alias("kind")).agg(F.count("*").cast("double").alias("mass"), F.lit(0.0).alias("gained"), F.count("*").alias("strong"), *both)
    unseen, evidence = edges.where("seed is null").drop("seed").withColumn("view", _view(F.col("side"))), seeds
    for turn in range(rounds):
        judged = evidence.groupBy(*p, "kind").agg(F.sum("mass").alias("mass"), F.sum("gained").alias("gained"), F.sum("strong").alias("strong"), *both).where(F.col("strong") >= support)
        n = F.col("known") + F.col("gained") + DOUBT * (F.col("degree") - F.col("known") - F.col("gained"))
        patterns = stored(judged.select(*p, "kind", _lower(F.least(F.col("mass"), n), n).alias("confidence")), f"scores{turn}")
        if turn == rounds - 1:
            break
        met = unseen.join(patterns, p).where(_alike(F.col("kind"), F.col("token")))
        # what the other views say of a token, for each view
        others = F.array_remove(F.array(*map(F.lit, sorted(set(VIEWS.values())))), F.col("view"))
        said = met.groupBy("token", "kind", "view").agg(F.max("confidence").alias("score"))
        told = stored(said.select("token", "kind", "score", F.explode(others).alias("view")).groupBy("token", "kind", "view").agg(F.max("score").alias("score")), f"told{turn}")
        gained = unseen.join(told, ["token", "view"]).groupBy(*p, "kind").agg(F.sum("score").alias("mass"), F.sum("score").alias("gained"), F.count_if(F.col("score") >= confidence).alias("strong"), *both)
        evidence = seeds.unionByName(gained)
    return patterns.where(F.col("confidence") >= confidence)


def named_places(candidates: DataFrame, trusted: DataFrame) -> DataFrame:
    """(tkey, start, stop, kind): tokens that are no base match and stand in a trusted pattern, of its surest kind."""
    at = candidates.where("seed is null or seed = 'secret'").select("tkey", "start", "stop", "token", F.inline("patterns"))
    met = at.join(trusted, ["side", "context"]).where(_alike(F.col("kind"), F.col("token")))
    return met.groupBy("tkey", "start", "stop").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))


def _beside(places: DataFrame, base: DataFrame) -> DataFrame:
    """The places that meet no base span of their text, by one pass over a text's spans in order."""
    spans = base.join(places.select("tkey").distinct(), "tkey", "left_semi").select("tkey", F.inline("base").alias("kind", "start", "stop"), F.lit(False).alias("new"))
    every = spans.unionByName(places.withColumn("new", F.lit(True)))
    in_order = Window.partitionBy("tkey").orderBy("start", "new")
    reached = F.max(F.when(~F.col("new"), F.col("stop"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(~F.col("new"), F.col("start"))).over(in_order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("stop")) >= F.col("stop"))
    return every.withColumn("free", free).where("new and free").select("tkey", "kind", "start", "stop")


def find_private(docs: DataFrame, rounds: int = 3, confidence: float = 0.75, support: int = 5, names: tuple[str, str] = ("base_spans", "spans")) -> DataFrame:
    """docs with the columns `names`: base spans, and all spans (base and discovered, by kind as listed, then start)."""
    base, spans = names
    texts = stored(located(docs), "located")
    candidates = stored(candidates_of(texts), "identifiers")
    fresh = _beside(named_places(candidates, bootstrap(candidates, rounds, confidence, support)), texts)
    added = fresh.groupBy("tkey").agg(F.collect_list(F.struct("kind", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))).cast(SPAN).alias("added"))
    every = F.concat("base", F.coalesce("added", F.array().cast(SPAN)))
    all_ = F.concat(*[F.array_sort(of_kind(every, k)) for k in ALL_KINDS])
    private = texts.join(added, "tkey", "left").select(F.col("tkey").alias("__key"), F.col("base").alias("__base"), all_.alias("__all")).where("size(__all) > 0")
    # stored, so that the join has plain shuffles on both sides and the rows of a text with many copies can be split
    private = stored(private, "private")
    keyed = docs.drop(base, spans).withColumn("__tkey", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = keyed.join(private, F.col("__tkey") == F.col("__key"), "left")
    none = F.array().cast(SPAN)
    return joined.withColumns({base: F.coalesce("__base", none), spans: F.coalesce("__all", none)}).drop("__tkey", "__key", "__base", "__all")


def as_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))


def masked(docs: DataFrame) -> DataFrame:
    """docs with each found span of the text replaced by its kind in brackets; other columns as they were.

    Overlapping spans are masked as one, named after the first.  n_chars, where there is one, follows the text.
    """
    text = F.col("text").cast("string")
    found = find_private(docs, names=("__first", "__spans"))
    ordered = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, a["upto"] + 1, s["start"] - a["upto"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["upto"], s["stop"]).alias("upto"), F.when(s["start"] < a["upto"], a["out"]).otherwise(F.array_append(a["out"], piece)).alias("out"))

    whole = F.aggregate(ordered, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["upto"] + 1, F.length(text))))
    found = found.withColumn("__clean", F.when(F.size("__spans") > 0, whole).otherwise(text))
    columns = {"text": F.col("__clean").alias("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.size("__spans") > 0, F.length("__clean")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return found.select(*[columns.get(c, F.col(f"`{c}`")) for c in docs.columns])


def op7_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(of_kind(F.col("base_spans"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("base_spans")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))

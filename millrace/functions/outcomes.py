"""What an attempt's reply means: retry or not, pressure or not, and the error to store."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest quoted body, longest wait between attempts, and the factor range of a server-given wait.
QUOTED, LONGEST_WAIT, STRETCH = 300, 60.0, 0.2


def classify(status: Column, retry_after: Column, text: Column) -> Column:
    """struct(retry, pressure, breaker_fail, error) of a reply outside 2xx."""
    said, code = F.substring(F.coalesce(text, F.lit("")), 1, QUOTED), status.cast("string")
    redirect, quota, poison = (status >= 300) & (status < 400), status == 429, (status >= 400) & (status < 500)
    error = (
        F.when(redirect, F.concat(F.lit("http "), code, F.lit(": endpoint redirects — use the final URL")))
        .when(poison & ~quota, F.concat(F.lit("http "), code, F.lit(": "), said))
        .otherwise(F.concat(F.lit("http "), code, F.lit(" after retries: "), said))
    )
    lost = redirect | (poison & ~quota)
    return F.struct((~lost).alias("retry"), (~lost & (~quota | retry_after.isNull())).alias("pressure"), (~lost & ~quota).alias("breaker_fail"), error.alias("error"))


def retry_after_seconds(value: Column, now: Column | None = None) -> Column:
    """Delta seconds with at most one dot, or an HTTP date less `now` (seconds since 1970); anything else is null."""
    number = F.when(value.rlike(r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), value.try_cast("double"))
    if now is None:
        return number
    date = F.regexp_extract(value, r"^[A-Z][a-z]{2}, ([0-9]{2} [A-Z][a-z]{2} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}) GMT$", 1)
    then = F.unix_seconds(F.try_to_timestamp(F.concat(date, F.lit(" +0000")), F.lit("dd MMM yyyy HH:mm:ss xx")))
    return F.coalesce(number, F.when(then.isNotNull(), F.greatest(then - now, F.lit(0))).cast("double"))


def next_wait(delay: Column, retry_after: Column, dice: Column) -> Column:
    """struct(wait, next_delay): full jitter up to delay, or the server's wait stretched a little; dice is in [0, 1)."""
    wait = F.when(retry_after.isNotNull(), retry_after * (1 + STRETCH * dice)).otherwise(delay * dice)
    return F.struct(wait.alias("wait"), F.least(delay * 2, F.lit(LONGEST_WAIT)).alias("next_delay"))


def row_error(errors: Column) -> Column:
    """The last attempt's error, naming the first's if it differs; errors is an array in order."""
    first, last = F.try_element_at(errors, F.lit(1)), F.try_element_at(errors, F.lit(-1))
    return F.when(F.size(errors) <= 0, F.lit("retry budget exhausted")).when(first == last, last).otherwise(F.concat(last, F.lit(" (first attempt: "), first, F.lit(")")))


def token_count(body: Column, path: str) -> Column:
    """A count of a JSON reply: a number, cut to a whole one, not negative; anything else is 0."""
    value = F.try_variant_get(F.try_parse_json(body), path, "variant")
    number = F.try_variant_get(value, "$", "double")
    kind = F.schema_of_variant(value)
    is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(is_number & ~F.isnan(number), F.greatest(F.floor(F.abs(number)) * F.signum(number), F.lit(0)).cast("long")).otherwise(F.lit(0).cast("long"))


def is_json_object(body: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False))


def capped_timeout(limit: Column, cap: float) -> Column:
    """A phase's limit of at most cap seconds; null or 0 means it had none."""
    return F.when(limit.isNull() | (limit == 0), F.lit(float(cap))).otherwise(F.least(limit, F.lit(float(cap))))


def total_timeout(*limits: Column) -> Column:
    """The limit of a whole request: the sum of its phases' limits, or none if a phase has none."""
    lacks = F.lit(False)
    for x in limits:
        lacks = lacks | x.isNull() | (x == 0)
    return F.when(~lacks, sum(limits[1:], limits[0]))


def slug(text: Column) -> Column:
    """A text as a path part: separators doubled to dashes, runs of other odd characters to one."""
    plain = F.regexp_replace(F.replace(text, F.lit("/"), F.lit("--")), "[^A-Za-z0-9._@-]+", "-")
    return F.regexp_replace(plain, "^-+|-+$", "")

"""Numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds and names of amount ranges.
AMOUNT_RANGES = ((1e5, "<100K"), (5e5, "~500K"), (2e6, "~1.5M"), (1e7, "~5M"), (5e7, "~25M"), (2e8, "~100M"))
TOP_RANGE = "~500M"


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for vectors of different lengths, empty ones and those of norm 0."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norms = [F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))) for v in (a, b)]
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms[0] > 0) & (norms[1] > 0)
    return F.when(usable, dot / (norms[0] * norms[1])).otherwise(0.0)


def parse_amount(s: Column) -> Column:
    """A French or English amount as a double, with its multiplier word or sign; null without digits."""
    low = F.lower(s)
    by = (
        F.when(F.contains(low, F.lit("milliard")), 1e9)
        .when(low.rlike("million|m€|m "), 1e6)
        .when(low.rlike("k€|k "), 1e3)
        .otherwise(1.0)
    )

    def value(kept: Column) -> Column:
        dots, commas = (F.length(kept) - F.length(F.replace(kept, F.lit(c), F.lit(""))) for c in ".,")
        # Where both occur, the separator that occurs once, or last, is the decimal one.
        comma_decimal = (dots > 1) | ((commas == 1) & (F.instr(F.reverse(kept), ",") > 0) & kept.rlike(r"^[^,]*,[^.]*$"))
        as_comma = F.translate(kept, ",.", ".")
        return F.when(comma_decimal, as_comma).otherwise(F.replace(kept, F.lit(","), F.lit(""))).try_cast("double")

    # Bound once, so that the value's many uses of the digits stay small.
    number = F.transform(F.array(F.regexp_replace(s, r"[^0-9.,]", "")), value)[0]
    return number * by


def amount_range(s: Column) -> Column:
    """The range of an amount; one that does not parse is in the lowest."""

    def named(x: Column) -> Column:
        out = F.lit(TOP_RANGE)
        for most, name in reversed(AMOUNT_RANGES):
            out = F.when(x < most, name).otherwise(out)
        return F.when(x.isNull(), AMOUNT_RANGES[0][1]).otherwise(out)

    return F.transform(F.array(parse_amount(s)), named)[0]


def address_range(s: Column) -> Column:
    """An address without its house number, or a placeholder where there is none to take away or nothing is left."""
    rest = F.regexp_replace(s, r"^\d+[a-zA-Z]?\s+", "")
    return F.when((rest == s) | (F.trim(rest) == ""), "[ADDR_GENERALIZED]").otherwise(rest)


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def card_fee(cents: Column) -> Column:
    return F.round((cents + 30) / 0.956 * 0.044 + 30).cast("long")


def micro_cents(cents: Column) -> Column:
    return F.round(cents * 1_000_000).cast("long")


def backoff_millis(attempt: Column) -> Column:
    return F.least(F.lit(2000) * F.pow(F.lit(2.0), attempt - 1), F.lit(30_000.0)).cast("long")


def model_cost(tokens: dict[str, Column], price: dict[str, float], long_price: dict[str, float] | None = None) -> Column:
    """Cost in USD of input, output, reasoning, cache reads and writes at prices per million; reasoning at the output price."""

    def at(p: dict[str, float]) -> Column:
        parts = [
            tokens["input"] * p["input"],
            (tokens["output"] + tokens["reasoning"]) * p["output"],
            tokens["cache_read"] * p.get("cache_read", 0.0),
            tokens["cache_write"] * p.get("cache_write", 0.0),
        ]
        return (parts[0] + parts[1] + parts[2] + parts[3]) / 1_000_000

    if long_price is None:
        return at(price)
    return F.when(tokens["input"] + tokens["cache_read"] > 200_000, at(long_price)).otherwise(at(price))


def quota(used: Column, limit: Column, updated: Column, now: Column, start: Column, end: Column) -> Column:
    """(status, reset_in_sec, usage_percent) of a window; usage from before its start counts as none."""
    current = F.when(updated >= start, used).otherwise(0)
    percent = F.floor(F.least(F.lit(100.0), current * 100.0 / limit)).cast("int")
    left = F.ceil((F.unix_millis(end) - F.unix_millis(now)) / 1000)
    return F.struct(F.when(current >= limit, "rate-limited").otherwise("ok").alias("status"), left.alias("reset_in_sec"), percent.alias("usage_percent"))

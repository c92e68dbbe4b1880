"""Token usage of model calls: what providers report, what it costs, and how much of a quota it takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where the providers' formats keep their counts, as JSON paths; of several paths the first that is there.
FORMATS = {
    "anthropic": {
        "input": ["input_tokens"],
        "output": ["output_tokens"],
        "cache_read": ["cache_read_input_tokens"],
        "cache_write_5m": ["cache_creation.ephemeral_5m_input_tokens"],
        "cache_write_1h": ["cache_creation.ephemeral_1h_input_tokens"],
    },
    "openai": {
        "input": ["input_tokens"],
        "output": ["output_tokens"],
        "reasoning": ["output_tokens_details.reasoning_tokens"],
        "cache_read": ["input_tokens_details.cached_tokens"],
    },
    "oa-compat": {
        "input": ["prompt_tokens"],
        "output": ["completion_tokens"],
        "reasoning": ["completion_tokens_details.reasoning_tokens"],
        "cache_read": ["cached_tokens", "prompt_tokens_details.cached_tokens"],
    },
    "google": {
        "input": ["promptTokenCount"],
        "output": ["candidatesTokenCount"],
        "reasoning": ["thoughtsTokenCount"],
        "cache_read": ["cachedContentTokenCount"],
    },
}
KINDS = ("input", "output", "reasoning", "cache_read", "cache_write_5m", "cache_write_1h")
# Formats whose input counts the cached tokens too, and whose output counts the reasoning too.
INPUT_HOLDS_CACHED = ("openai", "oa-compat", "google")
OUTPUT_HOLDS_REASONING = ("openai",)
LONG_CONTEXT = 200_000
COMPACTION_BUFFER = 20_000


def normalized(json: Column, kind: Column) -> Column:
    """A struct of the six token counts of a usage record in the provider's format ``kind``; null for an unknown format.

    Input and output are without cached and reasoning tokens. A count that is not reported is null, input and output 0.
    """

    def read(paths: list[str]) -> Column:
        return F.coalesce(*[F.get_json_object(json, f"$.{p}").cast("long") for p in paths]) if paths else F.lit(None).cast("long")

    out = F.lit(None)
    for name, paths in FORMATS.items():
        n = {k: read(paths.get(k, [])) for k in KINDS}
        zero = {k: F.coalesce(v, F.lit(0)) for k, v in n.items()}
        if name == "google":
            n |= {k: zero[k] for k in ("reasoning", "cache_read")}
        n["input"] = zero["input"] - (zero["cache_read"] if name in INPUT_HOLDS_CACHED else 0)
        n["output"] = zero["output"] - (zero["reasoning"] if name in OUTPUT_HOLDS_REASONING else 0)
        out = F.when(kind == name, F.struct(*[n[k].alias(k) for k in KINDS])).otherwise(out)
    return out


def server_cost(usage: Column, price: dict[str, float], long_price: dict[str, float] | None = None) -> Column:
    """Cents for the counts of :func:`normalized` at prices per token; cache writes count towards the long-context price too."""
    n = {k: F.coalesce(usage[k], F.lit(0)) for k in KINDS}

    def at(p: dict[str, float]) -> Column:
        total = n["input"] * p["input"] * 100 + n["output"] * p["output"] * 100 + n["reasoning"] * p["output"] * 100
        for k in KINDS[3:]:
            total = total + n[k] * (p.get(k) or 0.0) * 100
        return total

    if long_price is None:
        return at(price)
    context = n["input"] + n["cache_read"] + n["cache_write_5m"] + n["cache_write_1h"]
    return F.when(context > LONG_CONTEXT, at(long_price)).otherwise(at(price))


def finite(x: Column) -> Column:
    """The number, or 0 where it is null, infinite or no number."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def adjusted(input_: Column, output: Column, read: Column, write: Column, total: Column, excludes_cached: Column, sums: Column) -> Column:
    """struct(input, total): input without cached tokens, unless the provider leaves these out itself; the total is summed where ``sums`` holds."""
    i, o, r, w = (finite(x) for x in (input_, output, read, write))
    own = F.when(excludes_cached, i).otherwise(i - r - w)
    return F.struct(own.alias("input"), F.when(sums, own + o + r + w).otherwise(total.cast("double")).alias("total"))


def overflows(total: Column, parts: list[Column], context: Column, input_limit: Column, most_output: Column) -> Column:
    """Whether a session's tokens fill what the model leaves for input; never for a model without a context limit.

    A total of 0 or none counts as the sum of the parts. A limit on the input of 0 or none leaves the context less the output.
    """
    summed = parts[0]
    for p in parts[1:]:
        summed = summed + p
    count = F.when(F.coalesce(total, F.lit(0)) != 0, total).otherwise(summed)
    reserved = F.least(F.lit(COMPACTION_BUFFER), most_output)
    usable = F.when(F.coalesce(input_limit, F.lit(0)) != 0, input_limit - reserved).otherwise(context - most_output)
    return (context != 0) & (count >= usable)


def percent(part: Column, whole: Column) -> Column:
    """A share in percent with one decimal; half is rounded up."""
    return F.floor(part * 1000.0 / whole + 0.5) / 10


def _analysis(used: Column, limit: Column, fresh: Column, now: Column, end: Column, idle: Column) -> Column:
    left = F.ceil((F.unix_millis(end) - F.unix_millis(now)) / 1000)
    over = fresh & (used >= limit)
    share = F.when(~fresh, 0).when(over, 100).otherwise(F.floor(F.least(F.lit(100.0), used * 100.0 / limit)))
    return F.struct(
        F.when(over, "rate-limited").otherwise("ok").alias("status"),
        F.when(fresh, left).otherwise(idle).cast("long").alias("reset_in_sec"),
        share.cast("int").alias("usage_percent"),
    )


def rolling(used: Column, limit: Column, updated: Column, now: Column, hours: int) -> Column:
    """struct(status, reset_in_sec, usage_percent) of a window that began at the last update; an older one is over."""
    window = F.expr(f"interval {hours} hours")
    return _analysis(used, limit, updated >= now - window, now, updated + window, F.lit(hours * 3600))


def weekly(used: Column, limit: Column, updated: Column, now: Column) -> Column:
    """As :func:`rolling` for weeks from Monday midnight on."""
    start = F.date_trunc("week", now)
    end = start + F.expr("interval 7 days")
    return _analysis(used, limit, updated >= start, now, end, F.ceil((F.unix_millis(end) - F.unix_millis(now)) / 1000))


def monthly(used: Column, limit: Column, updated: Column, now: Column, start: Column, end: Column) -> Column:
    """As :func:`rolling` for a month with given bounds."""
    return _analysis(used, limit, updated >= start, now, end, F.ceil((F.unix_millis(end) - F.unix_millis(now)) / 1000))

"""Token accounting and cost of one row or one group."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.identity import is_claude
from meterline.functions.text import tidy


def clamp(c: Column) -> Column:
    return F.greatest(c, F.lit(0).cast("bigint"))


def cache_read(cached: Column, cache: Column, cache_write: Column) -> Column:
    return F.when(cached > 0, cached).otherwise(clamp(clamp(cache) - clamp(cache_write)))


def norm_cache(cached: Column, cache: Column, cache_write: Column) -> Column:
    return F.when(cache > 0, F.greatest(cache, clamp(cached), clamp(cache_write))).otherwise(
        clamp(cached) + clamp(cache_write))


def exclusive(provider: Column, inp: Column, out: Column, cache: Column, total: Column) -> Column:
    """Does the provider count cached input outside the input tokens?"""
    return is_claude(provider) | (
        (tidy(provider) == "") & (total > 0) & (total >= clamp(inp) + clamp(out) + cache))


def effective_total(provider, inp, out, cached, cache, cache_write, total) -> Column:
    both = clamp(inp) + clamp(out)
    nc = norm_cache(cached, cache, cache_write)
    return F.greatest(clamp(total), both,
                      F.when(exclusive(provider, inp, out, nc, total), both + nc).otherwise(F.lit(0)))


def uncached_input(provider, inp, out, cached, cache, cache_write, total) -> Column:
    nc = norm_cache(cached, cache, cache_write)
    return F.when(exclusive(provider, inp, out, nc, total), clamp(inp)).otherwise(clamp(clamp(inp) - nc))


def raw_tokens(df: DataFrame) -> DataFrame:
    """Vendor detail (cached, cache_read, cache_creation, …) to the stored token columns."""
    c = F.col
    df = df.withColumns({
        "_read": F.greatest(clamp(c("cached_tokens")), clamp(c("cache_read_tokens"))),
        "_write": clamp(c("cache_creation_tokens")),
    })
    both = clamp(c("input_tokens")) + clamp(c("output_tokens"))
    cache = c("_read") + c("_write")
    computed = both + F.when(exclusive(c("provider"), c("input_tokens"), c("output_tokens"), cache,
                                       c("total_tokens")), cache).otherwise(F.lit(0))
    return df.withColumns({
        "total_tokens": F.greatest(clamp(c("total_tokens")), computed),
        "cached_tokens": c("_read"), "cache_tokens": cache, "cache_write_tokens": c("_write"),
    }).drop("_read", "_write", "cache_read_tokens", "cache_creation_tokens")


def anthropic_adjust(df: DataFrame, family: Column) -> DataFrame:
    """Bodies of the Anthropic protocol: count cache reads and writes once."""
    c = F.col
    extra = c("cache_read_tokens") + c("cache_creation_tokens")
    inp, out, total = c("input_tokens"), c("output_tokens"), c("total_tokens")
    claude = family == "claude"
    widened = inp + extra + out
    return df.withColumns({
        "input_tokens": F.when((extra > 0) & ~claude, inp + extra).otherwise(inp),
        "total_tokens": F.when((extra > 0) & (claude | (total != 0)), F.greatest(total, widened)).otherwise(total),
    })


def with_effective(df: DataFrame) -> DataFrame:
    """Add effective_tokens, read_tokens and the clamped parts used by every aggregate."""
    c = F.col
    return df.withColumns({
        "effective_tokens": effective_total(c("provider"), c("input_tokens"), c("output_tokens"),
                                            c("cached_tokens"), c("cache_tokens"),
                                            c("cache_write_tokens"), c("total_tokens")),
        "read_tokens": cache_read(c("cached_tokens"), c("cache_tokens"), c("cache_write_tokens")),
    })


def micro_cost(provider: Column, inp: Column, out: Column, read: Column, write: Column, total: Column,
               prompt: Column, completion: Column, cache: Column, cache_write: Column) -> Column:
    """Exact cost in millionths (decimal); 0 where no price is known."""
    def dec(c):
        return c.cast("decimal(20,0)")

    def price(c):
        return c.cast("decimal(12,6)")

    i, o, r, w = clamp(inp), clamp(out), clamp(read), clamp(write)
    unc = F.when(exclusive(provider, i, o, r + w, total), i).otherwise(clamp(i - r - w))
    cost = dec(unc) * price(prompt) + dec(o) * price(completion) + dec(r) * price(cache) + dec(w) * price(cache_write)
    return F.coalesce(cost.cast("decimal(34,6)"), F.lit(0).cast("decimal(34,6)"))


def dollars(micro: Column, digits: int = 6) -> Column:
    return F.round(micro.cast("double") / 1e6, digits)


def generation_speed(output: Column, latency: Column, ttft: Column, stream: Column) -> Column:
    """Output tokens per second; NULL unless both parts are positive."""
    spent = F.when(stream, latency - clamp(ttft)).otherwise(latency)
    return F.when((output > 0) & (spent > 0), output * 1000 / spent)

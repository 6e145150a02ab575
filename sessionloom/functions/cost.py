"""Token usage and price columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_KEYS = ["llm_requests", "input_tokens", "output_tokens", "total_tokens", "cache_read_tokens"]

# USD per million tokens; the second row of a model applies above the threshold.
HIGH_CONTEXT_THRESHOLD = 272000
PRICES = [
    # model, tier, input, cached input, output
    ("gpt-5.4", "base", "2.5", "0.25", "15"),
    ("gpt-5.4", "high", "5", "0.5", "22.5"),
    ("gpt-5.5", "base", "5", "0.5", "30"),
    ("gpt-5.5", "high", "10", "1", "45"),
]


def split_provider(model: Column) -> Column:
    """struct<provider, model_ref>; a colon splits before a slash, an empty provider is null."""

    def parts(sep: str) -> Column:
        provider = F.substring_index(model, sep, 1)
        rest = F.substr(model, F.length(provider) + 2)
        return F.struct(F.nullif(provider, F.lit("")).alias("provider"), rest.alias("model_ref"))

    alone = F.struct(F.lit(None).cast("string").alias("provider"), model.alias("model_ref"))
    return F.when(model.contains(":"), parts(":")).when(model.contains("/"), parts("/")).otherwise(alone)


def price_key(model_ref: Column) -> Column:
    """Price-table name of a model reference."""
    name = F.replace(F.lower(F.trim(model_ref)), F.lit("_"), F.lit("-"))
    return (
        F.when(name.startswith("gpt-5.5") | name.startswith("gpt-5-5"), "gpt-5.5")
        .when(name.startswith("gpt-5.4") | name.startswith("gpt-5-4"), "gpt-5.4")
        .otherwise(name)
    )


def token_count(*values: Column) -> Column:
    """First given value as a whole number (fractions are cut); 0 when none is given."""
    return F.coalesce(*[v.cast("bigint") for v in values], F.lit(0).cast("bigint"))


def normalize_usage(usage: Column) -> Column:
    """struct of counts from a VARIANT usage object with the usual alternative key names."""

    def number(*paths: str) -> Column:
        return token_count(*[F.try_variant_get(usage, f"$.{p}", "double") for p in paths])

    def first_positive(*paths: str) -> Column:
        return F.coalesce(*[F.nullif(number(p), F.lit(0)) for p in paths], F.lit(0).cast("bigint"))

    prompt = number("input_tokens", "prompt_tokens")
    output = number("output_tokens", "completion_tokens")
    direct = number("cache_read_tokens", "cached_input_tokens")
    cached = F.when(direct != 0, direct).otherwise(
        first_positive("prompt_tokens_details.cached_tokens", "input_tokens_details.cached_tokens")
    )
    total = number("total_tokens")
    return F.struct(
        prompt.alias("input_tokens"),
        output.alias("output_tokens"),
        F.when(total != 0, total).otherwise(prompt + output).alias("total_tokens"),
        F.when(prompt > 0, F.least(cached, prompt)).otherwise(cached).alias("cache_read_tokens"),
    )


def price_table(spark) -> DataFrame:
    """The four fixed price rows as a table: model, tier, input, cached, output (exact decimals)."""
    rate = T.DecimalType(18, 9)
    raw = spark.createDataFrame(PRICES, "model string, tier string, input string, cached string, output string")
    return raw.select("model", "tier", *[F.col(c).cast(rate).alias(c) for c in ("input", "cached", "output")])


def with_price(calls: DataFrame, provider: str = "provider", model_ref: str = "model_ref", name: str = "price_usd") -> DataFrame:
    """Add the price of each call; null for an unknown model or another provider.

    The price table is fixed and tiny, so joining it by broadcast is always bounded.
    """
    tier = F.when(F.col("input_tokens") > HIGH_CONTEXT_THRESHOLD, "high").otherwise("base")
    home = F.coalesce(F.lower(F.trim(provider)), F.lit("")).isin("", "openai")
    keyed = calls.withColumns({"_model": F.when(home, price_key(F.col(model_ref))), "_tier": tier})
    prices = price_table(calls.sparkSession).withColumnsRenamed(
        {"model": "_model", "tier": "_tier", "input": "_in", "cached": "_cached", "output": "_out"}
    )
    count = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("decimal(18,0)")
    prompt = count("input_tokens")
    cached = F.least(count("cache_read_tokens"), prompt)
    total = (prompt - cached) * F.col("_in") + cached * F.col("_cached") + count("output_tokens") * F.col("_out")
    priced = keyed.join(F.broadcast(prices), ["_model", "_tier"], "left")
    return priced.withColumn(name, (total / F.lit(1_000_000)).cast("double")).drop("_model", "_tier", "_in", "_cached", "_out")


def effective_cost(reported: Column, computed: Column, priced: Column, any_tokens: Column) -> Column:
    """struct<usd, source>: the provider's figure if positive or nothing was used, then computed, then priced."""
    use_reported = reported.isNotNull() & ((reported > 0) | ~any_tokens)
    use_computed = computed.isNotNull() & ((computed > 0) | ~any_tokens)
    usd = F.when(use_reported, reported).when(use_computed, computed).otherwise(F.coalesce(priced, F.lit(0.0)))
    source = (
        F.when(use_reported, "reported")
        .when(use_computed, "computed")
        .when(priced.isNotNull(), "price_table")
        .when(any_tokens, "usage_no_price")
    )
    return F.struct(usd.alias("usd"), source.alias("source"))

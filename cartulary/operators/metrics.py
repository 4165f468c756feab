"""Tokens, prices and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.operators import prefix

# Dollars for a million tokens in and out.
PRICES = (
    ("gpt-4o", 2.50, 10.00),
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4-turbo", 10.00, 30.00),
    ("gpt-4", 30.00, 60.00),
    ("gpt-3.5-turbo", 0.50, 1.50),
    ("claude-3-5-sonnet-latest", 3.00, 15.00),
    ("claude-3-5-haiku-latest", 0.80, 4.00),
    ("claude-3-opus-latest", 15.00, 75.00),
    ("gemma4:latest", 0.0, 0.0),
    ("llama3.2:latest", 0.0, 0.0),
    ("llama3.1:latest", 0.0, 0.0),
    ("mistral:latest", 0.0, 0.0),
)


def price_of(model: str | None) -> tuple[float, float] | None:
    """The listed prices of one model by the rule of ``priced``, on the driver."""
    fits = [(model != k, -len(k), n, i, o) for n, (k, i, o) in enumerate(PRICES) if model is not None and (k in model or model in k)]
    return min(fits)[3:] if fits else None


def priced(df: DataFrame, model: str = "model", first: bool = False) -> DataFrame:
    """Add price_in and price_out: of the model itself, else of the longest listed name it holds or is part of.

    first: the first such name in the list, as the list's order once decided.  Distinct models are looked up, not rows.
    """
    spark = df.sparkSession
    prices = spark.createDataFrame([(k, i, o, n) for n, (k, i, o) in enumerate(PRICES)], "k string, i double, o double, n int")
    names = df.select(F.col(model).alias("_m")).where(F.col(model).isNotNull()).distinct()
    fits = F.contains("_m", "k") | F.contains("k", "_m")
    best = F.col("n") if first else F.struct(-F.length("k"), F.col("n"))
    order = F.struct((F.col("_m") != F.col("k")).alias("other"), best.alias("best"))
    found = names.join(F.broadcast(prices), fits).groupBy("_m").agg(F.min_by(F.struct("i", "o"), order).alias("p"))
    return df.join(found, F.col(model) == F.col("_m"), "left").select(*df.columns, F.col("p.i").alias("price_in"), F.col("p.o").alias("price_out"))


def cost(tokens_in, tokens_out, price_in, price_out):
    """Dollars, to six places, half to even; null without a price."""
    return F.bround(tokens_in / F.lit(1e6) * price_in + tokens_out / F.lit(1e6) * price_out, 6)


def cached_cost(tokens_in, read, written, tokens_out, rates: dict[str, float] | None):
    """Dollars where cached tokens have rates of their own; 0 for a model without rates."""
    if not rates:
        return F.lit(0.0)
    plain = F.greatest(tokens_in - read - written, F.lit(0))
    return (plain * rates["input"] + read * rates["read"] + written * rates["write"] + tokens_out * rates["output"]) / F.lit(1e6)


def generation(df: DataFrame, tokens: str, accepted: str, long: int = 512, most_rejected: float = 0.1) -> DataFrame:
    """One row on generated documents: written, rejected, those of more than ``long`` tokens, and whether too many were rejected."""
    written, rejected = F.count_if(F.col(accepted)), F.count_if(~F.col(accepted))
    return df.agg(written.alias("written"), rejected.alias("rejected"), F.count_if(F.col(accepted) & (F.col(tokens) > long)).alias("long_documents"), (rejected > (written + rejected) * F.lit(most_rejected)).alias("warn"))


def running_cost(df: DataFrame, order: str, amount: str, cap: float, *keys: str, per_task: int = prefix.PER_TASK) -> DataFrame:
    """Add ``running`` and keep what began before the sum passed ``cap``: the row that passes it is the last.

    The sum follows one order over all rows, or over those of each key (say, a run); see ``prefix.running``.
    """
    return prefix.running(df, order, amount, keys, per_task=per_task).where(F.col("running") - F.col(amount) <= cap)

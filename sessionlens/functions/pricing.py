"""Model prices and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: USD per million tokens of input, output, cache read and cache write; the first name contained in the model's counts.
PRICES = {
    "opus": (15.0, 75.0, 1.5, 18.75),
    "sonnet": (3.0, 15.0, 0.30, 3.75),
    "haiku": (1.0, 5.0, 0.10, 1.25),
}


def _by_model(model: Column, values: dict[str, float], otherwise: float | None) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for name, value in values.items():
        out = out.when(F.lower(F.coalesce(model, F.lit(""))).contains(name), F.lit(value))
    return out.otherwise(F.lit(otherwise).cast("double"))


def estimated_cost(model: Column, input_tokens: Column, output_tokens: Column, cache_read: Column, cache_creation: Column) -> Column:
    """USD by the price table; 0 for a model without a price."""
    counts = (input_tokens, output_tokens, cache_read, cache_creation)
    terms = [n * _by_model(model, {k: p[i] for k, p in PRICES.items()}, 0.0) for i, n in enumerate(counts)]
    return (terms[0] + terms[1] + terms[2] + terms[3]) / F.lit(1e6)


def cache_saved(model: Column, cache_read: Column) -> Column:
    """USD that cached reads saved against fresh input; null for a model without a price or without cached reads."""
    return F.when(cache_read > 0, _by_model(model, {k: p[0] - p[2] for k, p in PRICES.items()}, None) / F.lit(1e6) * cache_read)

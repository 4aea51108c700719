"""Column expressions: keys, prices, coercions, text."""

"""Training-data operators: search, privacy, tokenisation, dedup, quality, mixing, extraction, toxicity, archives.

Nothing else in the library imports this subpackage.
"""

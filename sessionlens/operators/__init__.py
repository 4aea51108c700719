"""Reusable relational operators: axis of truth, merges, deltas, pairing, retention."""

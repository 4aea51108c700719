"""Inputs: driver tables, transcripts, OTLP/JSON, append-aware tailing."""

"""The query catalogue as lazy plans."""

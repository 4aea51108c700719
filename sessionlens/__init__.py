"""Analytics of AI-coding-session telemetry on Spark."""

"""Versioned regulatory text on Spark: ingest, parse, diff, search, answer, monitor and measure."""

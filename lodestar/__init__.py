"""Spark-first analytics engine for code facts, telemetry and run catalogues."""

"""Telemetry analytics on Spark: labels, windows, scoring, fleet state, drift and metric rules."""

"""Temporal property graphs and time series on Spark."""

"""Adaptive time-series backtesting and data preparation as Spark jobs."""

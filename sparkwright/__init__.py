"""Spark-first analytics: relational, time-series, statistical and simulation operators as DataFrame plans."""

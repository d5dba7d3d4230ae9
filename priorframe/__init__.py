"""Leakage-safe analytics over event logs, written as Spark DataFrame operators."""

"""Sensor time-series analytics as Spark DataFrame operators."""

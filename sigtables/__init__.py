"""Signals, pulses and run regression as Spark DataFrame jobs."""

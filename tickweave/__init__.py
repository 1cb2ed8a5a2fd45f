"""Synchrophasor analytics as Spark DataFrame jobs."""

"""Signals, trends and audits over time-stamped text and event tables, as Spark plans."""

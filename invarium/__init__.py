"""Trace-invariant analytics on Spark: mine, check and report behavioural invariants of execution traces."""

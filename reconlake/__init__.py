"""Reconciliation analytics on Spark: sources, scalar functions, operators, plans and streaming ingest."""

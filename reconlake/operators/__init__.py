"""Operators on movement tables: candidates, assignment, resolution, deduplication, reports and journals."""

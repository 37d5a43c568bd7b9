"""Incremental versions of the monthly aggregates."""

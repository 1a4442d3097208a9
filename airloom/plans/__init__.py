"""Whole queries built from the operators: ingest, merge, charts, report, runs."""

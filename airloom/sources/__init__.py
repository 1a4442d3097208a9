"""Readers of landed measurement files and the partitioned measurement store."""

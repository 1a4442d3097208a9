"""DataFrame operators: dedup, joins, aggregates, distributions, validation, drift."""

"""Column-level functions: index bands, local-time features, text and nested access."""

"""Column functions: spans, checks, rewritings of texts."""

"""Column functions: ranks, text, checksums, spans."""

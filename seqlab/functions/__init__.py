"""Column-expression helpers: ordered block scans, fixed codes, address parsing."""

"""Readers: ordered log lines, weather and instance CSV, LibSVM, parquet tables."""

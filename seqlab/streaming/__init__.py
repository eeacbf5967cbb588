"""Structured Streaming jobs: word counts and online learners."""

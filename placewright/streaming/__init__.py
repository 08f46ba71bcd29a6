"""Streams of candidate points, checked as they arrive."""

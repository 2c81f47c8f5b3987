"""Operators over DataFrames: gates, generation, ladders, documents, scores, latency."""

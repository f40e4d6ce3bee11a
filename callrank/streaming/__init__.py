"""Structured Streaming entry points.

The reference has no stream; the only streaming use is K1 batch scoring
applied to client files as they arrive (same operator, streaming source).
"""

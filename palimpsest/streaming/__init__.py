"""Streaming twins of the analytics, and the stateful rate limiter."""

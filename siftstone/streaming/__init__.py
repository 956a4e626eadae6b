"""Structured Streaming: rate limits, conversation memory, votes and sessions."""

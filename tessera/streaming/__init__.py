"""Streaming twins of ingestion and conversation state."""

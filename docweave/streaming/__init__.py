"""Structured Streaming around the same operators: new pages, new decisions, resumable block state."""

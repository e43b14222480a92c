"""Structured Streaming: tail, running counters, intervals and keyed state."""

"""Scans and sinks, each with an explicit schema."""

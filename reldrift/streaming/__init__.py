"""Structured Streaming forms of change detection and finding publication."""

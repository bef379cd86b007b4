"""Structured Streaming: change events, debouncing, continuous synchronisation."""

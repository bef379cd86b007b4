"""The queries of this repository with their SQL equivalents."""

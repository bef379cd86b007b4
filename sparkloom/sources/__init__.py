"""Readers and writers: repository files, submodules, configuration, state, memory blocks."""

"""Incremental versions of the index, the running candidates and the merging of scenes."""

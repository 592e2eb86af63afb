"""Incremental forms of the features that have one."""

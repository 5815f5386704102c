"""Incremental loads that follow the resumable batch runs."""

"""Readers and writers that turn decoded files into tables and back."""

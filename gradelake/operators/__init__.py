"""Relational operators over the scan, exam, reply and mark tables."""

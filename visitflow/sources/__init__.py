"""Readers, writers and the fixed schema of the visit table."""

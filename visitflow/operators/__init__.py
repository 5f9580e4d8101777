"""Operators over the visit table: each takes a DataFrame and returns a lazy DataFrame."""

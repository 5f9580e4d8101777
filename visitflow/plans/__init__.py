"""Batch jobs and query entry points composed of the operators."""

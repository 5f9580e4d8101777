"""Operators for preparing training text, each one module, with the queries that apply them in ``registry``."""

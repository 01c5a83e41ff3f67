"""Operators for preparing training text: ten numbered operators and the queries that apply them."""

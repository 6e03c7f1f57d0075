"""Operators for preparing training text: scoring, filtering, mixing, formatting.

Nothing outside this folder imports it, so it can be removed as a whole.
"""

"""Readers of documents, judgments, rules and baselines."""

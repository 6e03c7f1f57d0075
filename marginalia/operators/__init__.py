"""Operators over tables of documents, segments and signals."""

"""Whole readings: from documents to verdicts and reports."""

"""Operators of a training-data pipeline: mixing, deduplication, language and quality scoring, web archives, tokens.

Nothing outside this subpackage imports it; it can be deleted without touching the rest of the library.
"""

"""Operators for preparing text corpora, their queries and check statements; nothing else in the library imports this."""

"""Training-data operators: search, deduplication, tokenisation, packing and scoring.

Self-contained: nothing else in the library imports this subpackage.
"""

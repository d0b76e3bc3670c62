"""Training-data operators: deduplication, filtering, tokenisation, packing.

Nothing outside this subpackage imports it.
"""

"""Training-data operators: dedup, search, packing, mixing, filters, extraction.

Nothing outside this subpackage imports it.
"""

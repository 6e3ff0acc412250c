"""Training-data operators: near-duplicate removal, tokens, packing, filters and search.

Nothing outside this package imports it.
"""

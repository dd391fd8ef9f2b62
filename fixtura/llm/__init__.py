"""Training-data operators: tokenising, sharding, de-duplication, search, formatting, filtering and extraction.

Nothing outside this subpackage imports it.
"""

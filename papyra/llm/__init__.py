"""Training-data operators: deduplication, fingerprints, filters, archives, mixing.

Nothing outside this subpackage imports it.
"""

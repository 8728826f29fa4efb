"""Training-data operators: deduplication, packing, extraction, sharding, mixing, token files, filters and fingerprints.

Nothing else in the library imports this subpackage.
"""

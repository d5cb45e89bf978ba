"""Training-data operators: packing, deduplication, scoring, mixing and friends.

Nothing else in the library imports this subpackage.
"""

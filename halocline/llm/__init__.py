"""Training-data operators (deduplication, packing, mixing, scoring, extraction).

Nothing else in the package imports this subpackage.
"""

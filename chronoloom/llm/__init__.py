"""Training-data operators: packing, quality, deduplication, decontamination, storage.

Nothing else in the package imports this subpackage.
"""

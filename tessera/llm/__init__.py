"""Training-data operators: packing, deduplication, filters, tokenisation, rollups.

Nothing else in the library imports this package; it can be deleted whole.
"""

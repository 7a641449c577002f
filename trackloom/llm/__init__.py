"""Training-data operators: deduplication, filtering, formatting and counting of text tables.

Nothing else in the library imports this subpackage.
"""

"""Training-data operators: tokenising, filtering, deduplication and archives.

Nothing else in the library imports this subpackage.
"""

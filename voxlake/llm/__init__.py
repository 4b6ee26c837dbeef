"""Training-data operators: deduplication, filters, classifiers, sharding, tokenizing.

Nothing else in the library imports this subpackage.
"""

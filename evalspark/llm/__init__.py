"""Operators for preparing training data: filters, classifiers, deduplication, decontamination, packing, sharding."""

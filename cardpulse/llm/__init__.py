"""Corpus operators for training-data pipelines: extraction, dedup, classifiers, PII, packing, search."""

"""Operators for preparing training text: packing, filters, classifiers, near-duplicates, tokens, scans."""

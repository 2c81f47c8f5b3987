"""Whole jobs: simplify a corpus, translate it, prepare training data, score systems."""

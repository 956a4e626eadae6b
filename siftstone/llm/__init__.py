"""Training-data operators: fingerprints, language, tokens, classifiers, dedup, extraction."""

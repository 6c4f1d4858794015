"""Training-data operators: language, extraction, tokens, safety, dedup.  Nothing else in the package imports this."""

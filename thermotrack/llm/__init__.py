"""Training-data operators: deduplication, classifiers, mixing, tokens, chat format, vector search."""

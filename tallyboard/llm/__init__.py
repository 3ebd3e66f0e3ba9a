"""Training-data operators: language, duplicates, tokens, packing, privacy, scoring, mixing."""

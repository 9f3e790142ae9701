"""Training-data operators: tokens, duplicates, secrets, packing, language and contamination."""

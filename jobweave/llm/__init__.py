"""Training-data operators: deduplication, decontamination, scoring, tokenizing, privacy and retrieval over whole corpora."""

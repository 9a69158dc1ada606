"""Training-data operators: deduplication, language ID, packing, scoring, mixing and token files."""

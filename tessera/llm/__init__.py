"""Training-data operators: deduplication, filtering, scoring, mixing, extraction, archives and search."""

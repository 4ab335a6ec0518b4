"""Training-data operators: formatting, mixing, filtering, deduplication, screening and encoding."""

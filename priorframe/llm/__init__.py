"""Training-data operators: scanning, filtering, deduplication, mixing, scoring."""

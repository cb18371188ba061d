"""Training-data operators: tokenising, filtering, deduplication, scoring and mixing of document tables."""

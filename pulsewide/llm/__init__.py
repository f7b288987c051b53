"""Training-data operators: extraction, filters, deduplication, formatting and mixing."""

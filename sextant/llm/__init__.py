"""Training-data operators: extraction, scans, scoring and deduplication of text corpora."""

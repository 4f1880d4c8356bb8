"""Training-data operators: dedup, scans, scoring, mixing and encoding of document tables."""

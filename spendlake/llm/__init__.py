"""Training-data operators: packing, token files, deduplication, mixing, scans, counts, rules, classification."""

"""Training-data operators: deduplication, classifiers, fingerprints, scans, mixing and packing."""

"""Training-data operators: filters, scans, near-duplicates, packing and archives."""

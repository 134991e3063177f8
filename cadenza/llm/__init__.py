"""Training-data operators: filters, classifiers, tokenizing, packing, deduplication."""

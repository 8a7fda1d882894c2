"""Training-data operators: deduplication, tokenizers, filters, packing, sketches."""

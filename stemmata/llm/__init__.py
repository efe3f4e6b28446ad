"""Training-data operators: text deduplication, decontamination, filters, packing and sharding."""

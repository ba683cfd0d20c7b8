"""Training-data operators: tokenizers, extraction, packing, deduplication, labelling, sharding."""

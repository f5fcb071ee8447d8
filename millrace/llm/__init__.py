"""Training-data operators: dedup, quality, decontamination, packing, token files, sharding, secrets, extraction."""

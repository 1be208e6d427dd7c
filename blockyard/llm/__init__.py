"""Training-data operators (token counts, near-duplicate search, mixing, toxicity, WARC, decontamination,
substring dedup, token files, sharding). Nothing else in the library imports this subpackage."""

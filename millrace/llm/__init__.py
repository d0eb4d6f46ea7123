"""Training-data operators: mixing, URL filters, quality, toxicity, fingerprints, WARC, packing, token counts, sharding, near-duplicates,
alignment of tokenizers, word BPE, divergence of sources."""

"""Training-data operators: fingerprints, token files, BPE, extraction, chat, packing, search, deduplication, language ID."""

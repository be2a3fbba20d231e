"""Training-data operators: deduplication, quality, formatting, privacy, decontamination, mixing."""

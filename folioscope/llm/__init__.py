"""Training-data operators: WARC, mixing, token output, dedup, quality, decontamination, chat, toxicity."""

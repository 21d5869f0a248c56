"""Training-data operators: deduplication, tokenisation, mixing, filtering and formatting of text corpora."""

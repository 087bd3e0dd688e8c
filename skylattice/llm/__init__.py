"""Training-data operators: deduplication, tokenization, scoring, archives. Nothing outside imports this."""
